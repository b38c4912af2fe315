"""Relational operators of the library: scans, filters, joins, aggregates, windows, sorting, set operations.

Each query is one statement for Spark, written once with the few spellings that differ left to the dialect, so that
Catalyst sees the whole plan: pushed filters, pruned columns, one pass for all aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.library import NOW, Dialect, query, with_tables

SQL: dict[str, Callable[[Dialect], str]] = {}


def sql(name: str) -> Callable:
    def keep(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        SQL[name] = f
        return f

    return keep


def q(name: str, text: str) -> None:
    SQL[name] = lambda d: text


# scans (S1-S11)
q("s1_live_scan", "select id, title, created_at from live where user_id = 3")
q("s2_point_lookup", "select id, title, case when length(full_text) > 32000 then concat(substring(full_text, 1, 32000), ' [truncated]') else full_text end as body from live where id = 42 and user_id = 2")
q("s3_hydrate_in_rank_order", "with ranked as (select id as rid, row_number() over (order by word_count desc, id) as rk from live) select r.rk, i.id, i.title, i.word_count from ranked r join items i on i.id = r.rid where r.rk <= 50 order by r.rk")


@sql("s7_json_api_projection")
def _(d: Dialect) -> str:
    return "select event_id, event_type, cast(" + ("get_json_object(props, '$.k')" if d.spark else "json_extract_string(props, '$.k')") + " as bigint) as k from events"


q("s9_item_projection", "select id, user_id, url, title, author, lang, source, word_count, minutes, is_read, is_archived, is_public, read_position, status from live")

# filters (F1-F12)
q("f1a_author_substring", "select id, author from live where title <> '' and author ilike '%thor 2%'")
SQL["f1b_any_tag_substring"] = lambda d: f"select id from live where title <> '' and {d.any('tags', 't', chr(39).join(['lower(t) like ', '%topic 3%', '']))}"
q("f1c_site_substring", "select id, url from live where title <> '' and url ilike '%src7.%'")
q("f1d_is_state", "select id, case when is_read = false then 'unread' when is_read then 'read' end as state, is_archived from live where is_read = false or is_archived")
q("f1e_before_after", "select id, created_at from live where created_at < timestamp '2024-01-20 00:00:00' and created_at >= timestamp '2024-01-05 00:00:00'")
_F2 = lambda d: f"live where user_id = 2 and is_archived = false and {d.has('tags', chr(39) + 'en' + chr(39))}"
SQL["f2_list_filter_exact_tag"] = lambda d: f"select id, (select count(*) from {_F2(d)}) as total from {_F2(d)}"  # an aggregate: a window would take one task
q("f3_post_filter_after_paging", "with page as (select id, created_at from live order by id limit 40 offset 20) select id, created_at from page where created_at is not null and created_at >= timestamp '2024-01-01 00:00:00'")
q("f4_reading_status", "select id, case when is_archived then 'archived' when is_read then 'read' when read_position >= 0.9 then 'read' when read_position > 0 then 'in_progress' else 'unread' end as status_shown from live")
q("f8_public_items", "select i.id, u.username from live i join users u on u.id = i.user_id where u.queue_public and i.is_public and not i.is_archived")
q("f9_public_records", "select r.id, u.username from records r join users u on u.id = r.owner_id where u.crates_public and not r.is_deleted")
q("f10_record_listing", "select id, artist, year from records where status = 'collection' and not is_deleted order by year desc nulls first, id")


q("f12_orphaned_highlights", "select h.id, h.item_id from highlights h join items i on i.id = h.item_id where i.is_deleted")

# joins (J1-J17)
q("j1_chunks_items", "select c.id, i.id as item, i.title from chunks c join live i on i.id = c.item_id")
q("j2_highlights_items", "select h.id, i.id as item, h.color from highlights h join live i on i.id = h.item_id where h.user_id = 1")
q("j3_list_highlights", "select m.list_id, h.id, h.created_at from highlights h join live i on i.id = h.item_id join membership m on m.item_id = i.id")
q("j4_list_items", "select m.list_id, i.id, i.title, m.added_at from live i join membership m on m.item_id = i.id")
q("j5_list_counts", "select l.id, l.name, count(i.id) as n_items from lists l left join membership m on m.list_id = l.id left join items i on i.id = m.item_id and not i.is_deleted group by l.id, l.name")
q("j6_entity_counts", "select e.id, count(m.item_id) as n_articles from entities e left join mentions m on m.entity_id = e.id group by e.id")
q("j7_items_without_chunks", "select i.id from live i left join chunks c on c.item_id = i.id where c.id is null and i.full_text is not null")
q("j9_not_in_purge", "select id from items where id not in (select min(id) from items group by user_id, url)")
q("j10_null_safe_anti", "select a.id from (select id, case when id % 4 = 0 then null else id % 40 end as k from live) a where not exists (select 1 from (select case when conv_id % 5 = 0 then null else conv_id end as k from conversations) b where a.k is not distinct from b.k)")
q("j11_semi_in", "select id, title from live where id in (select item_id from mentions where entity_id in (1, 2, 3, 5, 8))")
q("j13_vector_probe", "")
SQL["j13_vector_probe"] = lambda d: f"with p as (select embedding as pe, norm as pn from vectors where id = 7) select id, round({d.cosine('embedding', 'norm', 'pe', 'pn')}, 6) as sim from vectors cross join p where id <> 7 and {d.cosine('embedding', 'norm', 'pe', 'pn')} >= 0.1 order by sim desc, id limit 10"
q("j15_undirected_edges", "select n, count(distinct m) as degree from (select source_id as n, target_id + 1000000 as m from relations union all select target_id + 1000000, source_id from relations) e group by n")
q("j16_interval_overlap", "select a.id as x, b.id as y, greatest(a.start_offset, b.start_offset) as s, least(a.end_offset, b.end_offset) as e from highlights a join highlights b on a.item_id = b.item_id and a.id < b.id and a.start_offset < b.end_offset and a.end_offset > b.start_offset")

# aggregates
q("a1_user_stats", "select user_id, count(*) as total, count(case when is_read then 1 end) as n_read, count(case when is_read = false and is_archived = false then 1 end) as unread, count(case when is_archived then 1 end) as archived, cast(coalesce(sum(minutes), 0) as bigint) as minutes_all, cast(coalesce(sum(case when is_read then minutes end), 0) as bigint) as minutes_read from live group by user_id")
q("a2_reading_stats", "select user_id, count(*) as total, count(case when is_read then 1 end) as n_read, count(*) - count(case when is_read then 1 end) as unread from live group by user_id")
SQL["a3_tag_histogram"] = lambda d: f"select tag, count(*) as n from live {d.explode('tags', 'tag')} group by tag"
q("a4_distinct_authors", "select distinct user_id, lower(author) as author from live")
SQL["a5_max_similarity"] = lambda d: f"with p as (select embedding as pe, norm as pn from vectors where id = 7) select c.item_id, round(max({d.cosine('c.embedding', 'c.norm', 'pe', 'pn')}), 6) as sim from chunks c cross join p group by c.item_id"
q("a6_rrf", "with a as (select id, row_number() over (order by word_count desc, id) as rk from live), b as (select id, row_number() over (order by created_at desc, id) as rk from live) select id, round(sum(cast(1 as double) / (60 + rk)), 9) as score from (select * from a where rk <= 100 union all select * from b where rk <= 100) x group by id")
q("a12_total_count", "select count(*) as total from live where user_id = 1")
q("a13_rolling_mean", "select id, user_id, round(avg(minutes) over (partition by user_id order by read_at, id rows between 19 preceding and current row), 1) as mean_minutes from live where is_read")
q("a14_metric_means", "select event_type as variant, round(avg(value), 6) as mean_value, count(*) as n from activity group by event_type")
SQL["a15_latency_quantiles"] = lambda d: "select event_type, " + ("percentile(value, 0.5)" if d.spark else "quantile_cont(value, 0.5)") + " as p50, " + ("percentile(value, 0.95)" if d.spark else "quantile_cont(value, 0.95)") + " as p95 from activity group by event_type"

# windows (W1-W7)
q("w1_mentions_per_entity", "select entity_id, item_id, count(*) over (partition by entity_id) as n from mentions where user_id = 1")
q("w2_keep_latest", "select id, user_id, url from (select id, user_id, url, row_number() over (partition by user_id, url order by created_at desc, id) as rn from (select id, user_id, concat('https://', source, '/', cast(id % 50 as string)) as url, created_at from live) x) y where rn = 1")
q("w3_implicit_rank", "select id, round(cast(1 as double) / (60 + row_number() over (order by word_count desc, id)), 9) as score from live")
q("w4_top_k_per_group", "select source, id, rn from (select source, id, row_number() over (partition by source order by word_count desc, id) as rn from live) x where rn <= 20")
SQL["w6_slug_numbers"] = lambda d: f"select id, case when n = 1 then slug else concat(slug, '-', cast(n - 1 as string)) end as slug from (select id, slug, row_number() over (partition by slug order by id) as n from (select p_partkey as id, {d.gsub('lower(p_name)', '[^a-z0-9]+', '-')} as slug from part) x) y"

# sorting (T1-T8)
q("t1_top_k", "select id, word_count from live order by word_count desc, id limit 25")
q("t2_paging", "select id from live order by created_at desc, id limit 30 offset 60")
SQL["t3_multi_key_sort"] = lambda d: f"select id, {d.size(d.intersect('tags', d.array(chr(39) + 'en' + chr(39), chr(39) + 'Topic 2' + chr(39))))} as shared, word_count from live where tags is not null order by shared desc, word_count desc, id limit 40"
q("t4_stable_ties", "select id, min(lane * 1000000 + rk) as first_seen, round(sum(cast(1 as double) / (60 + rk)), 9) as score from (select id, 1 as lane, row_number() over (order by minutes desc, id) as rk from live union all select id, 2, row_number() over (order by created_at, id) from live) x group by id order by score desc, first_seen limit 50")
q("t5_limit_clamp", "select id from live order by id limit 50")
SQL["t6_index_sort"] = lambda d: f"select id, {d.gsub(d.group('url', '^https?://([^/]+)'), '^www[.]', '')} as domain from live order by domain, title desc, id limit 100"
q("t7_record_sort", "select id, artist, coalesce(year, 0) as y from records order by y desc, artist, id limit 30")
q("t8_reading_order", "select id, item_id, case when start_offset % 80 > 40 then 1 else 0 end as col from highlights order by item_id, col, start_offset, id")

# set operations
q("u1_union_lanes", "select item_id as id, 'chunk' as lane from chunks union all select i.item_id, 'item' from item_vectors i where not exists (select 1 from chunks c where c.item_id = i.item_id)")
q("u2_union_distinct", "select source_id as n from relations union select target_id from relations")
q("u4_difference", "select distinct source as label from items except select concat('src', cast(n_nationkey as string)) from nation")
SQL["u3_shared_tags"] = lambda d: f"with pref as (select user_id, {'collect_set(tag)' if d.spark else 'list(distinct tag)'} as preferred from (select user_id, tag from items {d.explode('tags', 'tag')} where is_read) t group by user_id) select l.id, {d.join(d.sorted(d.intersect('l.tags', 'pref.preferred')))} as shared from live l join pref on pref.user_id = l.user_id where {d.size(d.intersect('l.tags', 'pref.preferred'))} > 0"
SQL["u5_ordered_distinct"] = lambda d: f"select id, {d.join('array_distinct(genres)' if d.spark else 'case when genres[1] = genres[2] then [genres[1]] else genres end')} as genres from records"

# scalar functions (X2-X41, those that SQL expresses)
q("x5_is_pdf_url", "select page_id, (lower(split_part(url, '?', 1)) like '%.pdf' or lower(split_part(url, '?', 1)) like '%/pdf/%') as is_pdf from pages")


SQL["x7_html_to_plain"] = lambda d: f"select page_id, trim({d.gsub(d.gsub('html', '<[^>]+>', ' '), '[ \\t\\n\\r\\f\\v]+', ' ')}) as plain from pages"
q("x8_reading_time", "select id, word_count, minutes, greatest(1, cast(floor(word_count / 200) as bigint)) as pdf_minutes from items")
SQL["x13_cache_key"] = lambda d: "select item_id, concat('qemb:', substring(" + ("sha2(lower(trim(text)), 256)" if d.spark else "sha256(lower(trim(text)))") + ", 1, 16)) as cache_key from benchmark"
SQL["x15_cosine"] = lambda d: f"with p as (select embedding as pe, norm as pn from vectors where id = 7) select id, round({d.cosine('embedding', 'norm', 'pe', 'pn')}, 6) as sim, round(1 - (1 - {d.cosine('embedding', 'norm', 'pe', 'pn')}) / 2, 6) as half_scaled from vectors cross join p"
SQL["x16_label_rule"] = lambda d: f"select id, case when {d.words('substring(trim(name), 1, 100)')} between 1 and 6 then substring(trim(name), 1, 100) end as label from entities"
q("x19_relation_strength", "select source_id, target_id, type, greatest(1, least(5, case when (source_id + target_id) % 8 = 0 then 3 else (source_id + target_id) % 8 end)) / 5.0 as weight from relations")


SQL["x38_video_id"] = lambda d: f"select p_partkey, {d.group('u', '(?:v=|youtu[.]be/)([A-Za-z0-9_-]{11})')} as vid from (select p_partkey, concat('https://youtube.com/watch?v=', substring(concat('abcdefghijk', cast(p_partkey as string)), 1 + p_partkey % 4, 11)) as u from part) x"
SQL["x41_draft_query"] = lambda d: f"select id, word_count, case when word_count < 50 then null else concat(title, ' ', substring(full_text, 1, 200)) end as draft_query from items"


q("s11_telemetry_rows", "select id, user_id, event_type, ts from activity where event_type in ('click', 'view')")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, SQL[name](Dialect(True)))

    run.__name__ = name
    return run


QUERIES = {name: _run(name) for name in SQL}
ORACLES = {name: with_tables(f(Dialect(False)), Dialect(False)) for name, f in SQL.items()}
