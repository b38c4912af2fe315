"""Search, connections, recommendations, themes, duplicates and evaluation over whole tables.

The Spark side calls the operators; the SQL beside each query is written on its own from what the operator should give.
Thresholds are lower than the operators' defaults where the tables' vectors are further apart than a library's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import connections, curation, evaluation, graph, recommend, search
from quire.operators.similarity import best_match, matches, similar_pairs
from quire.sources.library import NOW, Dialect, query, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_d = Dialect(False)
def as_of() -> Column:
    return F.timestamp_seconds(F.lit(NOW))



def answer(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql, _d)
        return f

    return keep


def library(spark: SparkSession, sf_dir: str) -> search.Library:
    names = ("live", "chunks", "item_vectors", "entities", "mentions", "relations", "highlights")
    return search.Library(*[table(spark, sf_dir, n) for n in names])


def vector_of(spark: SparkSession, sf_dir: str, item: int = 7) -> list[float]:
    return list(table(spark, sf_dir, "item_vectors").where(F.col("item_id") == item).first()["embedding"])


def cos(a: str, b: str) -> str:
    return f"round(list_inner_product({a}.embedding::double[], {b}.embedding::double[]) / ({a}.norm * {b}.norm), 9)"


PROBE = "p as (select embedding, norm from item_vectors where item_id = 7)"


def semantic_sql(user: int | None, top: int) -> str:
    """(id, score, rank) by best chunk or by the item itself."""
    whose = "" if user is None else f"and user_id = {user}"
    return f"""
      select id, score, row_number() over (order by score desc, id) as rank from (
        select c.item_id as id, max({cos('c', 'p')}) as score from chunks c, p where c.item_id in (select id from live where title <> '' {whose}) group by 1
        union all select v.item_id, {cos('v', 'p')} from item_vectors v, p where v.item_id in (select id from live where title <> '' {whose}) and v.item_id not in (select item_id from chunks)
      ) s qualify row_number() over (order by score desc, id) <= {top}"""


def keyword_sql(user: int | None, top: int, condition: str) -> str:
    """(id, score, rank) where each token that fulfils the condition on ``w`` is a cover of its own in both dictionaries."""
    hit = lambda f: f"2 * len(list_filter(regexp_extract_all(lower(regexp_replace(coalesce({f}, ''), '<[^>]+>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?'), lambda w: {condition}))"
    whose = "" if user is None else f"and user_id = {user}"
    r = f"({hit('title')} + {hit('author')} + 0.4 * ({hit('description')} + {hit(chr(39).join(['array_to_string(tags, ', ' ', ')']))}) + 0.2 * {hit('full_text')})::double"
    return f"""
      select id, round(r / (r + 1), 9) as score, row_number() over (order by round(r / (r + 1), 9) desc, id) as rank from (select id, {r} as r from live where title <> '' {whose}) k
      where r > 0 qualify row_number() over (order by round(r / (r + 1), 9) desc, id) <= {min(top, 50)}"""


def entity_sql(user: int, top: int, name: str, gate: float, expand: float) -> str:
    """CTEs that end in ent (id, score, rank, via)."""
    return f"""
      es as (select e.id, e.name, case when lower(e.name) = lower({name}) then 1.0 else {cos('e', 'p')} end as sim, lower(e.name) = lower({name}) as ex from entities e, p where e.user_id = {user}),
      anchors as (select * from es where ex or sim >= {gate}),
      steps as (select target_id as id from relations where source_id in (select id from anchors where sim >= {expand}) union select source_id from relations where target_id in (select id from anchors where sim >= {expand})),
      chosen as (select id, name, sim from anchors union all select id, name, sim from es where sim > 0 and id in (select id from steps) and id not in (select id from anchors)),
      met as (select m.item_id as id, c.name, c.sim, c.sim / log2(2 + count(*) over (partition by m.entity_id)) as c from mentions m join chosen c on c.id = m.entity_id where m.user_id = {user}),
      ent0 as (select id, round(0.7 * max(c) + 0.3 * sum(c), 9) as score, string_agg(concat(name, '=', cast(round(sim, 4) as varchar)), ';' order by -round(sim, 4), name) as via from met group by id),
      ent as (select *, row_number() over (order by score desc, id) as rank from ent0 qualify row_number() over (order by score desc, id) <= {top})"""


def full_sql(user: int, limit: int, name: str, gate: float, expand: float, *, unread: bool = False, condition: str | None = None) -> str:
    n = 3 * limit
    lanes = []
    if unread:
        lanes.append(f"select id, 0 as lane, row_number() over (order by created_at desc, id) as rank, 1.0 / (60 + row_number() over (order by created_at desc, id)) as v, null::double as score, null as via from live where user_id = {user} and title <> '' and is_read = false qualify row_number() over (order by created_at desc, id) <= {n}")
    if condition:
        lanes.append(f"select id, 1, rank, 1.0 / (60 + rank), score, null from ({keyword_sql(user, n, condition)}) k")
    lanes.append(f"select id, 2, rank, 1.0 / (60 + rank), score, null from ({semantic_sql(user, n)}) s")
    lanes.append("select id, 3, rank, 0.025 * score, score, via from ent")
    return f"""
      with {PROBE}, {entity_sql(user, n, name, gate, expand)}, lanes(id, lane, rank, v, score, via) as ({' union all '.join(lanes)}),
      f as (select id, round(sum(v), 12) as fused, min(lane * 1000000 + rank) as seen, min(lane) as first, max(lane) = 3 as has_entity, max(case when lane = 2 then score end) as sem, max(via) as via from lanes group by id),
      r as (select *, row_number() over (order by fused desc, seen) as rank from f qualify row_number() over (order by fused desc, seen) <= {limit})
      select r.id, r.rank, round(1.0 / (60 + r.rank), 9) as score, concat(case when has_entity and first < 3 then 'entity+' else '' end, case first when 0 then 'filter' when 1 then 'keyword' when 2 then 'semantic' else 'entity' end) as match_type,
        round(fused, 9) as fused, case when first = 2 then round(sem, 6) end as semantic_score, case when first = 3 then via end as matched_via
      from r join live on live.id = r.id and live.user_id = {user}"""


def _via(column: str = "matched_via"):
    return F.array_join(F.transform(column, lambda m: F.concat(m["name"], F.lit("="), m["sim"].cast("string"))), ";")


@answer(f"with {PROBE} select id, round(score, 6) as score, rank from ({semantic_sql(None, 20)}) s")
def p1_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic(library(spark, sf_dir), vector_of(spark, sf_dir), 20)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@answer(f"select id, round(score, 6) as score, rank from ({keyword_sql(None, 50, '''w like 'von%' ''')}) k")
def p2_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.keyword(library(spark, sf_dir), "von", 50)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@answer(f"with {PROBE}, {entity_sql(1, 40, '(select name from entities where id = 11)', 0.2, 0.25)} select id, round(score, 6) as score, rank, via as matched_via from ent")
def p3_entity_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir).of(1)
    name = table(spark, sf_dir, "entities").where("id = 11").first()["name"]
    found = search.entity(lib, name, vector_of(spark, sf_dir), 40, gate=0.2, expand=0.25)
    return found.select("id", F.round("score", 6).alias("score"), "rank", _via().alias("matched_via"))


#: One query for each way of dispatch: filter, keyword, semantic, hybrid, keyword without hits.
ASKED = {"filter": 'author:"author 1" after:2023-12-20', "keyword": "von", "semantic": "what is the house?", "hybrid": "que OR von OR los", "fallback": "zzqqx"}
_WORDS = "w in ('que', 'von', 'los')"


@answer(f"""
  with {PROBE}, sem as ({semantic_sql(3, 30)}), kw as ({keyword_sql(3, 30, _WORDS)}), one as ({keyword_sql(3, 10, '''w like 'von%' ''')}),
  fl as (select id, row_number() over (order by created_at desc, id) as rank from live where user_id = 3 and title <> '' and lower(author) like '%author 1%' and created_at >= timestamp '2023-12-20'),
  hy0 as (select id, round(sum(v), 12) as fused, min(seen) as seen from (select id, 1.0 / (60 + rank) as v, 1000000 + rank as seen from kw union all select id, 1.0 / (60 + rank), 2000000 + rank from sem) x group by id),
  hy as (select id, fused, row_number() over (order by fused desc, seen) as rank from hy0),
  every as (
    select 'filter' as asked, id, rank, 1.0::double as score, 'filter' as match_type, null::double as fused from fl union all
    select 'keyword', id, rank, round(score, 6), 'keyword', null from one union all
    select 'semantic', id, rank, round(score, 6), 'semantic', null from sem union all
    select 'fallback', id, rank, round(score, 6), 'semantic_fallback', null from sem union all
    select 'hybrid', id, rank, round(1.0 / (60 + rank), 6), 'hybrid', round(fused, 9) from hy)
  select asked, id, rank, score, match_type, fused from every where rank <= 10""")
def p4_hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 for one user: each way that a query may go."""
    lib, vector, out = library(spark, sf_dir), vector_of(spark, sf_dir), None
    for name, text in ASKED.items():
        got = search.search(lib, text, vector, user_id=3, limit=10)
        rows = got.select(F.lit(name).alias("asked"), "id", "rank", F.round("score", 6).alias("score"), "match_type", F.round("fused", 9).alias("fused"))
        out = rows if out is None else out.unionByName(rows)
    return out


@answer(full_sql(1, 20, "'is:unread que OR von OR los'", 0.2, 0.25, unread=True, condition="w in ('von', 'los')"))
def p5_full_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search.search(library(spark, sf_dir), "is:unread que OR von OR los", vector_of(spark, sf_dir), user_id=1, mode="full", limit=20, gate=0.2, expand=0.25)
    return _shown(got)


def _shown(got: DataFrame) -> DataFrame:
    return got.select("id", "rank", F.round("score", 9).alias("score"), "match_type", F.round("fused", 9).alias("fused"), F.round("semantic_score", 6).alias("semantic_score"), _via().alias("matched_via"))


_TOKENS = "regexp_extract_all(lower(regexp_replace(h.text, '<[^>]+>', ' ', 'g')), '[\\p{L}\\p{N}]+(?:''[\\p{L}\\p{N}]+)?')"


@answer(f"""
  with hits as (select h.id, h.item_id, len(list_filter({_TOKENS}, lambda w: w like 'que%')) as n from highlights h join live i on i.id = h.item_id and i.user_id = 3 where h.user_id = 3),
  {PROBE}, kw as ({keyword_sql(3, 10, "w like 'que%'")})
  select 'highlight' as kind, id, item_id, round(0.1 * n, 6) as score from hits where n > 0 qualify row_number() over (order by n desc, id) <= 10
  union all select 'item', id, id, round(score, 6) from kw""")
def p6_unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search.unified(library(spark, sf_dir), "que", vector_of(spark, sf_dir), user_id=3, limit=10)
    items = got["items"].select(F.lit("item").alias("kind"), "id", F.col("id").alias("item_id"), F.round("score", 6).alias("score"))
    return got["highlights"].select(F.lit("highlight").alias("kind"), "id", "item_id", F.round("score", 6).alias("score")).unionByName(items)


@answer(f"""
  select h.id, round(0.1 * len(list_filter({_TOKENS}, lambda w: w like 'que%')), 6) as score from highlights h
  where list_contains(list_transform({_TOKENS}, lambda w: w like 'que%'), true) qualify row_number() over (order by len(list_filter({_TOKENS}, lambda w: w like 'que%')) desc, h.id) <= 10""")
def x24_highlight_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import fulltext

    found = fulltext.search(table(spark, sf_dir, "highlights"), "que", {"text": "D"}, limit=10, dictionaries=("simple",), damped=False)
    return found.select("id", F.round("score", 6).alias("score"))


@answer(f"select id, round(score, 6) as score from ({keyword_sql(None, 50, _WORDS)}) k")
def x23_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.keyword(library(spark, sf_dir), "que OR von OR los", 50)
    return found.select("id", F.round("score", 6).alias("score"))


@answer(f"""with {PROBE}, t as (select coalesce(tags, []) as tags from items where id = 7)
  select i.id, {cos('v', 'p')} as sim, array_to_string(list_sort(list_intersect(coalesce(i.tags, []), t.tags)), ',') as shared from item_vectors v join live i on i.id = v.item_id, p, t
  where v.item_id <> 7 and {cos('v', 'p')} >= 0.1 qualify row_number() over (order by sim desc, i.id) <= 20""")
def p7_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "items").where("id = 7").first()["tags"]
    got = connections.similar_items(table(spark, sf_dir, "item_vectors"), table(spark, sf_dir, "live"), 7, vector_of(spark, sf_dir), tags, least=0.1, limit=20)
    return got.select("id", "sim", F.array_join("shared", ",").alias("shared"))


def linked_sql(least: float, k: int) -> str:
    """CTE n (x, ix, y, iy, sim): nearest passages of other live articles."""
    return f"""n as (select a.id as x, a.item_id as ix, b.id as y, b.item_id as iy, {cos('a', 'b')} as sim from vectors a join vectors b on a.user_id = b.user_id and a.item_id <> b.item_id
      where length(b.text) >= 20 and b.item_id in (select id from live) and {cos('a', 'b')} >= {least} qualify row_number() over (partition by a.id order by sim desc, b.id) <= {k})"""


def _shared(x: str, y: str) -> str:
    return f"list_sort(list_intersect(coalesce({x}.tags, []), coalesce({y}.tags, [])))"


_BY_ARTICLE = f"""{linked_sql(0.2, 100)}, r as (select *, row_number() over (partition by x, iy order by sim desc, y) as nth from n),
  g as (select x, ix, iy, max(sim) as sim, string_agg(cast(y as varchar), ',' order by nth) as passages from r where nth <= 2 group by x, ix, iy),
  s as (select g.*, {_shared('a', 'b')} as shared from g left join live a on a.id = g.ix join live b on b.id = g.iy)"""
_ARTICLE_COLUMNS = "x, iy as item_id, passages, array_to_string(shared, ',') as shared, round(sim, 3) as score, row_number() over (partition by x order by len(shared) desc, sim desc, iy) as rank"


@answer(f"with {_BY_ARTICLE} select {_ARTICLE_COLUMNS} from s")
def p8_highlight_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = connections.by_article(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "live"), least=0.2)
    return _joined(got, "passages", "shared")


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


@answer(f"""with {_BY_ARTICLE}, first as (select id from vectors where item_id in (select id from live) qualify row_number() over (partition by item_id order by start_offset, id) <= 30)
  select ix, {_ARTICLE_COLUMNS} from s where x in (select id from first)""")
def p9_connections_by_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(connections.of_articles(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "live"), least=0.2), "passages", "shared")


@answer(f"""with {linked_sql(0.2, 20)}, h as (select *, round(1 - (1 - sim) / 2, 9) as half from n),
  b as (select * from h qualify row_number() over (partition by ix, iy order by half desc, x, y) = 1), s as (select b.*, {_shared('p', 'q')} as shared from b join live p on p.id = b.ix join live q on q.id = b.iy)
  select ix, iy, x, y, round(half, 6) as total_similarity, array_to_string(shared, ',') as shared, row_number() over (partition by ix order by len(shared) desc, half desc, iy) as rank from s""")
def p10_article_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(connections.best_pairs(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "live"), least=0.6), "shared")


@answer(f"with {linked_sql(0.2, 100)} select x, iy as item_id, y, round(sim, 6) as sim, row_number() over (partition by x, iy order by sim desc, y) as nth from n qualify nth <= 3")
def p17_insight_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections.insight_context(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "live"), least=0.2)


_PROFILE = """mean as (select user_id, round(avg(minutes), 1) as mean_minutes from (select user_id, minutes from items where is_read and minutes is not null qualify row_number() over (partition by user_id order by read_at desc, id desc) <= 20) m group by user_id),
  pref as (select user_id, list(distinct tag) as preferred from (select user_id, unnest(tags) as tag from items where is_read) t group by user_id)"""


@answer(f"""with {_PROFILE}, v as (select i.id, i.user_id, i.is_read, i.is_deleted, i.read_at, e.embedding, e.norm from items i join item_vectors e on e.item_id = i.id),
  best as (select u.id, max({cos('u', 'r')}) as best from v u join v r on r.user_id = u.user_id and r.id <> u.id where u.is_read = false and not u.is_deleted and r.is_read and epoch_us(r.read_at) >= ({NOW}::bigint - 7 * 86400) * 1000000 group by u.id),
  s as (select i.user_id, i.id, round(30 * coalesce(best, 0) + greatest(0.0, 20 - floor((({NOW}::bigint * 1000000) - epoch_us(created_at)) / 86400000000.0) / 10) + 10 * len(list_intersect(coalesce(list_distinct(tags), []), coalesce(preferred, [])))
      + case when mean_minutes is not null and minutes > 0 then greatest(0.0, 15 - abs(minutes - mean_minutes) / 2) else 0.0 end, 6) as score
    from items i left join best b on b.id = i.id left join mean on mean.user_id = i.user_id left join pref on pref.user_id = i.user_id where is_read = false and not is_deleted and not (coalesce(minutes, 0) > 10))
  select user_id, id, score, row_number() over (partition by user_id order by score desc, id) as rank from s qualify rank <= 20""")
def p11_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items")
    return recommend.recommended(items, table(spark, sf_dir, "item_vectors"), recommend.profiles(items), as_of(), mood="quick_read", limit=20)


@answer(f"with {_PROFILE} select coalesce(mean.user_id, pref.user_id) as user_id, mean_minutes, array_to_string(list_sort(preferred), ',') as preferred from mean full join pref on pref.user_id = mean.user_id")
def r12_rolling_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(recommend.profiles(table(spark, sf_dir, "items")), "preferred")


_TAG_VECTORS = "select concat('Topic ', cast(vec_id as string)) as label, embedding, vec_id from embeddings where vec_id < 9 union all select concat('src', cast(vec_id - 10 as string)), embedding, vec_id from embeddings where vec_id between 10 and 40 union all select case vec_id when 50 then 'en' when 51 then 'fr' else 'de' end, embedding, vec_id from embeddings where vec_id between 50 and 52"


def tag_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, _TAG_VECTORS)


@answer(f"""
  with recursive tv0 as ({_TAG_VECTORS}), tv as (select label, embedding, {Dialect(False).norm('embedding')} as norm from tv0),
  uses as (select user_id, id, unnest(tags) as tag from live where len(tags) > 0 and user_id in (select user_id from live where len(tags) > 0 group by user_id having count(*) >= 10)),
  tags as (select u.user_id, u.tag, count(*) as n, any_value(embedding) as embedding, any_value(norm) as norm from uses u join tv on tv.label = u.tag group by u.user_id, u.tag),
  e as (select a.user_id, a.tag as a, b.tag as b from tags a join tags b on a.user_id = b.user_id and a.tag <> b.tag where {cos('a', 'b')} >= 0.15),
  reach as (select user_id, tag as a, tag as b from tags union select r.user_id, r.a, e.b from reach r join e on e.user_id = r.user_id and e.a = r.b),
  comp as (select user_id, a as tag, min(b) as cluster from reach group by user_id, a),
  arts as (select c.user_id, c.cluster, list_sort(list(distinct u.id)) as items from comp c join uses u on u.user_id = c.user_id and u.tag = c.tag group by c.user_id, c.cluster having count(distinct u.id) >= 3),
  lab as (select c.user_id, c.cluster, c.tag as label from comp c join tags t on t.user_id = c.user_id and t.tag = c.tag qualify row_number() over (partition by c.user_id, c.cluster order by t.n desc, c.tag) = 1),
  names as (select user_id, cluster, list_sort(list(tag)) as tags from comp group by user_id, cluster)
  select a.user_id, l.label, array_to_string(n.tags, ',') as tags, len(a.items) as n_items, array_to_string(a.items, ',') as items from arts a join lab l on l.user_id = a.user_id and l.cluster = a.cluster join names n on n.user_id = a.user_id and n.cluster = a.cluster
  where (select count(*) from tags t where t.user_id = a.user_id) >= 2""")
def p12_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = recommend.themes(table(spark, sf_dir, "items"), tag_vectors(spark, sf_dir), least=0.15)
    return _joined(got.withColumn("n_items", F.size("items").cast("bigint")), "tags", "items")


@answer(f"""
  with recursive v as (select id, user_id, name, embedding, norm from entities where embedding is not null), n as (select a.id as x, b.id as y, {cos('a', 'b')} as sim from v a join v b on a.user_id = b.user_id and a.id <> b.id where {cos('a', 'b')} >= 0.2
      qualify row_number() over (partition by a.id order by sim desc, b.id) <= 20),
  pr as (select least(x, y) as a, greatest(x, y) as b, max(sim) as sim from n group by 1, 2),
  ok as (select pr.*, row_number() over (order by sim desc, a, b) as rn from pr join entities ea on ea.id = a join entities eb on eb.id = b
    where 1 - levenshtein(lower(trim(ea.name)), lower(trim(eb.name))) / greatest(length(trim(ea.name)), length(trim(eb.name)), 1)::double >= 0.4),
  walk as (select 0::bigint as rn, []::bigint[] as used, null::bigint as a, null::bigint as b, null::double as sim
    union all select ok.rn, case when list_contains(used, ok.a) or list_contains(used, ok.b) then used else list_concat(used, [ok.a, ok.b]) end, case when list_contains(used, ok.a) or list_contains(used, ok.b) then null else ok.a end, ok.b, ok.sim
      from walk join ok on ok.rn = walk.rn + 1)
  select a, b, round(sim, 6) as sim from walk where a is not null""")
def p13_entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("id", "user_id", "name", "embedding")
    got = curation.duplicate_entities(e, least=0.2, verify=lambda a, b: curation.same_name(a, b, 0.4))
    return got.select("a", "b", F.round("sim", 6).alias("sim"))


@answer(full_sql(2, 5, "''", 0.4, 0.45))
def p15_relevant_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.draft_reads(library(spark, sf_dir), "zzqq", "zzqq " * 60, vector_of(spark, sf_dir), user_id=2))


@answer("""select list_id, string_agg(line, '|' order by rn) as body from (select m.list_id, concat(i.title, ': ', coalesce(i.description, '')) as line, row_number() over (partition by m.list_id order by m.added_at, i.id) as rn from membership m join items i on i.id = m.item_id) x where rn <= 20 group by list_id""")
def p18_list_summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i = table(spark, sf_dir, "membership"), table(spark, sf_dir, "items").select(F.col("id").alias("item_id"), "title", "description")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("list_id").orderBy("added_at", "item_id"))
    lines = m.join(i, "item_id").withColumn("n", nth).where("n <= 20").select("list_id", F.struct("n", F.concat("title", F.lit(": "), F.coalesce("description", F.lit(""))).alias("line")).alias("s"))
    return lines.groupBy("list_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "|").alias("body"))


@answer("""select * from (select 'all' as mode, id, item_id, row_number() over (order by created_at desc, id) as rank from highlights where user_id = 3 qualify rank <= 100) a
  union all select 'item', id, item_id, row_number() over (order by start_offset, id) from highlights where item_id = 6
  union all select distinct 'list', h.id, h.item_id, dense_rank() over (order by h.created_at desc, h.id) from highlights h join live i on i.id = h.item_id join membership m on m.item_id = i.id where m.list_id = 7""")
def p19_highlights_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user (at most 100, newest first), by item (in reading order), by list (newest first)."""
    from pyspark.sql import Window

    h = table(spark, sf_dir, "highlights")
    newest = [F.desc("created_at"), F.asc("id")]
    rank = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank")
    mine = h.where("user_id = 3").orderBy(*newest).limit(100).select(F.lit("all").alias("mode"), "id", "item_id", rank(*newest))
    item = h.where("item_id = 6").select(F.lit("item").alias("mode"), "id", "item_id", rank("start_offset", "id"))
    members = table(spark, sf_dir, "membership").where("list_id = 7").select("item_id").distinct()
    live = table(spark, sf_dir, "live").select(F.col("id").alias("item_id"))
    listed = h.join(live, "item_id", "left_semi").join(members, "item_id", "left_semi").select(F.lit("list").alias("mode"), "id", "item_id", rank(*newest))
    return mine.unionByName(item).unionByName(listed)


@answer(f"with {_BY_ARTICLE} select {_ARTICLE_COLUMNS} from s where x = 7")
def a8_top_two_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    return _joined(connections.by_article(v, table(spark, sf_dir, "live"), least=0.2, sources=v.where("id = 7")), "passages", "shared")


@answer(f"""with {linked_sql(0.2, 20)}, b as (select iy, x, y, round(1 - (1 - sim) / 2, 9) as half from n where ix = 14 qualify row_number() over (partition by iy order by sim desc, x, y) = 1)
  select iy as item_id, x, y, round(half, 6) as sim from b where exists (select 1 from live where id = 14)""")
def a9_best_pair_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    got = connections.best_pairs(v, table(spark, sf_dir, "live"), least=0.6, sources=v.where("item_id = 14"))
    return got.select(F.col("iy").alias("item_id"), "x", "y", F.col("total_similarity").alias("sim"))


# similarity joins
_NEAR = f"n as (select a.id as x, b.id as y, {cos('a', 'b')} as sim from vectors a join vectors b on a.user_id = b.user_id and a.id <> b.id where {cos('a', 'b')} >= 0.25)"
_REACH = "e as (select a, b from pr union select b, a from pr), reach as (select a as id, a as r from e union select reach.id, e.b from reach join e on e.a = reach.r)"


@answer(f"with {_NEAR}, t as (select * from n qualify row_number() over (partition by x order by sim desc, y) <= 20) select least(x, y) as a, greatest(x, y) as b, round(max(sim), 6) as sim from t group by 1, 2")
def j12_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf_dir, "vectors"), least=0.25, per_id=20)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@answer(f"with recursive {_NEAR}, pr as (select x as a, y as b from n where x < y), {_REACH} select id, min(r) as component from reach group by id")
def g3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(similar_pairs(table(spark, sf_dir, "vectors"), least=0.25, per_id=None))


@answer(f"select u.id, round(max({cos('u', 'r')}), 6) as best from vectors u join vectors r on r.user_id = u.user_id and r.id <> u.id join items i on i.id = u.item_id join items j on j.id = r.item_id where i.is_read = false and j.is_read and epoch_us(j.read_at) >= ({NOW}::bigint - 7 * 86400) * 1000000 group by u.id")
def j14_max_similarity_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").select(F.col("id").alias("item_id"), "is_read", "read_at")
    v = table(spark, sf_dir, "vectors").join(items, "item_id")
    recent = v.where(F.col("is_read") & (F.unix_micros("read_at") >= (NOW - 7 * 86400) * 1_000_000))
    return best_match(v.where("is_read = false"), recent).select("id", F.round("best", 6).alias("best"))


@answer(f"""with {PROBE}, near as (select i.id, i.tags, {cos('v', 'p')} as sim from item_vectors v join live i on i.id = v.item_id, p where i.user_id = 2 and i.id <> 7 and len(i.tags) > 0 and {cos('v', 'p')} > 0.05 qualify row_number() over (order by sim desc, i.id) <= 3)
  select tag, count(*) as votes from (select unnest(tags) as tag from near) t group by tag having count(*) >= 2 order by votes desc, tag limit 5""")
def a10_neighbour_tag_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.tag_votes(table(spark, sf_dir, "live"), table(spark, sf_dir, "item_vectors"), 7, 2, vector_of(spark, sf_dir), least=0.05)


# evaluation: every vector is a query, its 20 nearest are what came back, relevant are those of its user with its label
def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, sf_dir, "vectors").select("id", "user_id", "label", "embedding")
    nth = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "y")).cast("bigint")
    ranked = matches(v, v, k=20).select(F.col("x").alias("q"), F.col("y").alias("id"), nth.alias("rank"))
    hits = ranked.join(v.select(F.col("id").alias("q"), F.col("label").alias("lq")), "q").join(v.select("id", "label"), "id").where("lq = label")
    ranks = hits.groupBy("q").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    many = v.groupBy("user_id", "label").agg((F.count("*") - 1).alias("n"))
    out = v.join(many, ["user_id", "label"]).select(F.col("id").alias("q"), "n").join(ranks, "q", "left")
    return out.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<bigint>")))


def _metric(column: str, make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _judged(spark, sf_dir).select(F.col("q").alias("x"), F.round(make(), 6).alias(column))

    return run


_LISTS = f"""r as (select a.id as x, a.label as lx, b.label as ly, row_number() over (partition by a.id order by {cos('a', 'b')} desc, b.id) as rk from vectors a join vectors b on a.user_id = b.user_id and a.id <> b.id),
  m as (select id as x, count(*) over (partition by user_id, label) - 1 as n from vectors), h as (select m.x, m.n, r.rk from m left join r on r.x = m.x and r.lx = r.ly and r.rk <= 20)"""
for _name, _column, _make, _sql in (
    ("e1_recall_at_k", "recall", lambda: evaluation.recall_at(10), "case when any_value(n) = 0 then 1.0 else count(case when rk <= 10 then 1 end) / any_value(n)::double end"),
    ("e2_precision_at_k", "prec", lambda: evaluation.precision_at(10), "count(case when rk <= 10 then 1 end) / 10.0::double"),
    ("e3_mrr", "rr", evaluation.reciprocal_rank, "coalesce(1.0::double / min(rk), 0.0)"),
    ("e4_ndcg", "ndcg", lambda: evaluation.ndcg_at(10), "case when any_value(n) = 0 then 0.0 else coalesce(sum(case when rk <= 10 then 1 / log2(rk + 1) end), 0.0) / list_sum(list_transform(range(1, least(10, any_value(n)) + 1), lambda k: 1 / log2(k + 1))) end"),
):
    QUERIES[_name] = _metric(_column, _make)
    QUERIES[_name].__name__ = _name
    ORACLES[_name] = with_tables(f"with {_LISTS} select x, round({_sql}, 6) as {_column} from h group by x", _d)


#: A baseline as a file of an earlier run holds it: values of the variants before a change.
BASELINE = {"signup": 50.0, "error": 49.0, "click": 60.0, "view": 10.0, "purchase": 50.02}


@answer(f"""select variant, metric, round(value, 6) as value, baseline, value < baseline - 0.02 as regressed from (select event_type as variant, 'value' as metric, avg(value) as value from activity group by event_type) m
  join (values {', '.join(f"('{k}', {v}::double)" for k, v in BASELINE.items())}) b(v, baseline) on v = variant""")
def e5_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "activity").groupBy(F.col("event_type").alias("variant")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("value"))
    base = spark.createDataFrame([(k, "value", v) for k, v in BASELINE.items()], "variant string, metric string, value double")
    return evaluation.regressed(means, base).withColumn("value", F.round("value", 6)).select("variant", "metric", "value", "baseline", "regressed")




@answer(f"""
  with {PROBE}, q as (select coalesce(tags, []) as tags from items where id = 7), {entity_sql(2, 60, "''", 0.2, 0.25)},
  sem as ({semantic_sql(2, 60)}), kw as ({keyword_sql(2, 60, _WORDS)}),
  whole as (select v.item_id as id, row_number() over (order by {cos('v', 'p')} desc, v.item_id) as rank from item_vectors v join live i on i.id = v.item_id and i.user_id = 2 and i.title <> '', p qualify rank <= 60),
  lanes as (select 'A' as variant, id, 1 as lane, rank, 1.0 / (60 + rank) as v from kw union all select 'A', id, 2, rank, 1.0 / (60 + rank) from whole
    union all select w, id, 1, rank, 1.0 / (60 + rank) from kw, (values ('B'), ('C'), ('D')) x(w) union all select w, id, 2, rank, 1.0 / (60 + rank) from sem, (values ('B'), ('C'), ('D')) x(w)
    union all select 'C', id, 3, rank, 1.0 / (60 + rank) from ent union all select 'D', id, 3, rank, 0.025 * score from ent),
  f as (select variant, id, row_number() over (partition by variant order by round(sum(v), 12) desc, min(lane * 1000000 + rank)) as rk from lanes group by variant, id),
  rel as (select id from live, q where user_id = 2 and len(list_intersect(coalesce(live.tags, []), q.tags)) > 0)
  select variant, round(count(case when rk <= 10 then 1 end) / 10.0::double, 6) as precision_at_10, round(count(case when rk <= 10 then 1 end) / (select count(*) from rel)::double, 6) as recall_at_10, round(1.0::double / min(rk), 6) as rr
  from f where id in (select id from rel) group by variant""")
def e6_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items only (A), with chunks (B), entity lane by rank (C), entity scores passed through (D); relevant are items that
    share a tag with the one asked about."""
    from pyspark.sql import Window

    lib, vector = library(spark, sf_dir).of(2), vector_of(spark, sf_dir)
    words = search.keyword(lib, "que OR von OR los", 60)
    none = lib.chunks.limit(0)
    whole = search.semantic(search.Library(lib.items, none, lib.item_vectors), vector, 60)
    chunked = search.semantic(lib, vector, 60)
    entities = search.entity(lib, "", vector, 60, gate=0.2, expand=0.25)
    rank_lane = lambda rows, n: rows.select("id", F.lit(n).alias("lane"), "rank", (F.lit(1.0) / (60 + F.col("rank"))).alias("v"))
    variants = {
        "A": [rank_lane(words, 1), rank_lane(whole, 2)],
        "B": [rank_lane(words, 1), rank_lane(chunked, 2)],
        "C": [rank_lane(words, 1), rank_lane(chunked, 2), rank_lane(entities, 3)],
        "D": [rank_lane(words, 1), rank_lane(chunked, 2), entities.select("id", F.lit(3).alias("lane"), "rank", (F.col("score") * search.ENTITY_SCALE).alias("v"))],
    }
    lanes = None
    for name, some in variants.items():
        for rows in some:
            one = rows.withColumn("q", F.lit(name))
            lanes = one if lanes is None else lanes.unionByName(one)
    fused = lanes.groupBy("q", "id").agg(F.round(F.sum("v"), 12).alias("v"), F.min(F.col("lane") * 1_000_000 + F.col("rank")).alias("seen"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("v"), "seen")).cast("bigint"))
    tags = table(spark, sf_dir, "items").where("id = 7").first()["tags"] or []
    relevant = lib.items.where(F.arrays_overlap("tags", F.lit(tags).cast("array<string>"))).select("id")
    names = ranked.select("q").distinct()
    judged = evaluation.judged(names, ranked, _each(spark, variants, relevant))
    return judged.select(F.col("q").alias("variant"), F.round(evaluation.precision_at(10), 6).alias("precision_at_10"), F.round(evaluation.recall_at(10), 6).alias("recall_at_10"), F.round(evaluation.reciprocal_rank(), 6).alias("rr"))


def _each(spark: SparkSession, names, rows: DataFrame) -> DataFrame:
    return rows.withColumn("q", F.explode(F.array(*map(F.lit, names))))
