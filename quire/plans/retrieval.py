"""Graph, membership and maintenance queries that are one statement, and ranks over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import ranking
from quire.sources.library import Dialect, query, table, with_tables

SQL: dict[str, Callable[[Dialect], str]] = {}

SQL["g1_two_hops"] = lambda d: "with e as (select source_id + 1000000 as a, target_id as b from relations union select target_id, source_id + 1000000 from relations), one as (select distinct b from e where a = 1000007), two as (select distinct e.b from e join one on one.b = e.a) select b as id from one union select b from two where b <> 1000007"
SQL["g4_items_of_entities"] = lambda d: "select distinct item_id from mentions where entity_id in (3, 14, 15) and item_id <> 9"
SQL["g9_membership_add"] = lambda d: "select c.item_id, case when m.item_id is null then 'added' else 'already_in_list' end as status from (select id as item_id, id % 25 as list_id from live) c left join (select distinct item_id, list_id from membership) m on m.item_id = c.item_id and m.list_id = c.list_id"
SQL["g12_accept_tags"] = lambda d: f"select id, case when id % 2 = 0 then {d.join('tags')} end as tags_now from live where tags is not null"
SQL["r4_backfill_oldest"] = lambda d: "select id from live where status = 'completed' and full_text is not null and is_read is null order by created_at, id limit 50"
SQL["r7_missing_chunks"] = lambda d: "select i.id from live i where not exists (select 1 from chunks c where c.item_id = i.id) order by i.id limit 100"
SQL["r8_untagged"] = lambda d: f"select id from live where {d.size('tags')} = 0"


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, SQL[name](Dialect(True)))

    run.__name__ = name
    return run


QUERIES = {name: _statement(name) for name in SQL}
ORACLES = {name: with_tables(f(Dialect(False)), Dialect(False)) for name, f in SQL.items()}


def w3_implicit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.global_rank(table(spark, sf_dir, "live").select("id", "word_count"), "word_count", "id")
    return ranked.select("id", F.round(F.lit(1.0) / (60 + F.col("rk")), 9).alias("score"))


QUERIES["w3_implicit_rank"] = w3_implicit_rank
ORACLES["w3_implicit_rank"] = with_tables("select id, round(1.0::double / (60 + row_number() over (order by word_count desc, id)), 9) as score from live", Dialect(False))
