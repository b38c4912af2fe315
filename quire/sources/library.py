"""The library's tables, as SQL over the raw tables, in the dialects of Spark and of the checking engine.

A library has items with tags and chunks, highlights on items, lists with memberships, an entity graph (entities,
mentions, relations), tag vectors and records.  Choices made here (which raw column stands for what) are not semantics
of the operators; both dialects make the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Dialect:
    """Spellings that differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def seconds(self, x: str) -> str:
        return f"timestamp_seconds({x})" if self.spark else f"make_timestamp(cast({x} as bigint) * 1000000)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def words(self, x: str) -> str:
        return f"regexp_count({x}, '\\\\S+')" if self.spark else f"len(regexp_extract_all({x}, '\\S+'))"

    def explode(self, array: str, name: str, alias: str = "u") -> str:
        """A join with the elements of an array column."""
        return f"lateral view explode({array}) {alias} as {name}" if self.spark else f"cross join unnest({array}) as {alias}({name})"

    def gsub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def group(self, x: str, pattern: str, k: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {k})" if self.spark else f"regexp_extract({x}, '{pattern}', {k})"

    def join(self, array: str, by: str = ",") -> str:
        return f"array_join({array}, '{by}')" if self.spark else f"array_to_string({array}, '{by}')"

    def sorted(self, array: str) -> str:
        return f"array_sort({array})" if self.spark else f"list_sort({array})"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_list({x}))" if self.spark else f"list_sort(list({x}))"

    def size(self, array: str) -> str:
        return f"cardinality({array})" if self.spark else f"len({array})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})" if self.spark else f"list_contains({array}, {x})"

    def any(self, array: str, name: str, condition: str) -> str:
        return f"exists({array}, {name} -> {condition})" if self.spark else f"(len(list_filter({array}, lambda {name}: {condition})) > 0)"

    def dot(self, a: str, b: str) -> str:
        """Sum of products in double precision."""
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, x) -> s + x)"
        return f"list_inner_product({a}::double[], {b}::double[])"

    def cosine(self, a: str, na: str, b: str, nb: str) -> str:
        return f"({self.dot(a, b)} / ({na} * {nb}))"

    def norm(self, a: str) -> str:
        return f"sqrt({self.dot(a, a)})"

    def days_between(self, a: str, b: str) -> str:
        """Whole days from a to b, rounded down."""
        if self.spark:
            return f"cast(floor((unix_micros({b}) - unix_micros({a})) / 86400000000D) as bigint)"
        return f"cast(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) as bigint)"

    def bround(self, x: str) -> str:
        return f"bround({x})" if self.spark else f"round_even({x}, 0)"


#: Entity types and ingest errors that the raw tables lack.
_KINDS = "PERSON,concept, Organization ,PAPER,tool,Material,TECHNIQUE,method,Algorithm,MODEL,framework,Library,DATASET,researcher,Institution,COMPANY,lab,PLACE,Event,Person"
_ERRORS = "HTTP 403 for url;401 Client Error;login required;blocks bots;captcha shown;429 Too Many Requests;500 Server Error;unexpected status code;Request timed out;DNS failure;connection reset;temporary outage;could not parse;;  ;Access denied by source;Cloudflare page;host unreachable;HTTPError;network down;empty body;Robot check;Authorization missing"

#: Time that "now" is in all queries; nothing reads a clock.
NOW = 1_706_745_600


def tables(d: Dialect) -> dict[str, str]:
    """SQL of each library table."""
    s = d.seconds
    day = 86400
    return {
        "items": f"""
            select t.doc_id as id, t.doc_id % 5 as user_id, concat('https://www.', t.source, '.example.com/', t.lang, '/', cast(t.doc_id as string)) as url,
              case when t.doc_id % 19 = 0 then '' else split_part(t.text, chr(10), 1) end as title, case when t.doc_id % 3 = 0 then null else substring(t.text, 5, 90) end as description,
              concat('Author ', cast(t.doc_id % 23 as string)) as author, t.text as full_text, t.lang, t.source,
              case when t.doc_id % 13 = 0 then null when t.doc_id % 13 = 1 then {d.array()} else {d.array("t.lang", "t.source", "concat('Topic ', cast(t.doc_id % 9 as string))")} end as tags,
              {d.words("t.text")} as word_count, cast(greatest(1, {d.bround(d.words("t.text") + " / 200.0")}) as bigint) as minutes,
              case when l.quality is null then null else l.quality = 1 end as is_read, t.doc_id % 7 = 0 as is_archived, t.doc_id % 3 = 0 as is_public,
              (t.doc_id % 11) / 10.0D0 as read_position, t.doc_id % 17 = 0 as is_deleted,
              {s(f"{NOW} - (t.doc_id * 7919) % (60 * {day})")} as created_at, {s(f"{NOW} - (t.doc_id * 104729) % (20 * {day})")} as read_at,
              case when t.doc_id % 29 = 0 then 'failed' else 'completed' end as status
            from documents t left join labels l on t.doc_id = l.doc_id""".replace("10.0D0", "10.0D" if d.spark else "10.0::double"),
        "live": "select * from items where not is_deleted",
        "users": "select c_custkey as id, c_name as username, c_acctbal > 0 as crates_public, c_nationkey % 2 = 0 as queue_public from customer",
        "vectors": f"select vec_id as id, vec_id % 5 as user_id, vec_id * 2 as item_id, label, substring(repeat('a passage of text ', 3), 1, 10 + cast(vec_id % 40 as int)) as text, vec_id % 3 * 50 as start_offset, embedding, {d.norm('embedding')} as norm from embeddings",
        "chunks": f"select vec_id as id, vec_id % 200 as item_id, embedding, {d.norm('embedding')} as norm from embeddings where vec_id % 4 <> 3",
        "item_vectors": f"select vec_id as item_id, embedding, {d.norm('embedding')} as norm from embeddings",
        "highlights": f"""
            select conv_id * 1000 + turn as id, conv_id as item_id, conv_id % 5 as user_id, text, role as color, turn * 40 as start_offset, turn * 40 + length(text) as end_offset,
              {s(f"{NOW} - (conv_id * 1000 + turn) * 613 % (30 * {day})")} as created_at from conversations""",
        "lists": f"select n_nationkey as id, n_nationkey % 5 as owner_id, n_name as name, n_regionkey, case when n_nationkey % 4 = 0 then null else concat('Notes on ', n_name, ' and region ', cast(n_regionkey as string)) end as description, {s(f'{NOW} - n_nationkey * 7919')} as updated_at from nation",
        "membership": "select o_orderkey as item_id, cast(o_custkey % 25 as bigint) as list_id, o_orderdate as added_at from orders where o_orderpriority <> '5-LOW'",
        "entities": f"""
            select p.p_partkey as id, p.p_partkey % 5 as user_id, concat(p.p_name, ' ', cast(p.p_partkey % 97 as string)) as name, split_part({_KINDS!r}, ',', cast(p.p_partkey % 20 + 1 as int)) as type, case when p.p_partkey % 3 = 0 then null else concat('made by ', p.p_brand) end as description, e.embedding,
              case when e.embedding is null then null else {d.norm('e.embedding')} end as norm from part p left join embeddings e on e.vec_id = p.p_partkey""",
        "mentions": "select distinct l_partkey as entity_id, l_orderkey as item_id, l_orderkey % 5 as user_id from lineitem",
        "relations": "select distinct l_suppkey as source_id, l_partkey as target_id, l_returnflag as type from lineitem",
        "records": f"""
            select s_suppkey as id, s_nationkey as owner_id, s_name as artist, concat('Album ', cast(s_suppkey % 37 as string)) as title,
              case when s_suppkey % 6 = 0 then null else 1950 + s_suppkey % 70 end as year, case when s_acctbal > 5000 then 'collection' else 'wantlist' end as status,
              {d.array("concat('g', cast(s_suppkey % 7 as string))", "concat('g', cast(s_suppkey % 3 as string))")} as genres, {d.array("concat('style ', cast(s_suppkey % 5 as string))")} as styles,
              case when s_suppkey % 9 = 0 then null else {d.array("concat('shelf ', cast(s_suppkey % 4 as string))")} end as tags, case when s_suppkey % 7 = 0 then null else concat('Label ', cast(s_suppkey % 11 as string)) end as label,
              {s(f"{NOW} - s_suppkey * 7919 % (90 * {day})")} as created_at, s_suppkey % 8 = 0 as is_deleted from supplier""",
        "activity": f"select event_id as id, user_id, event_type, value, ts from events",
        "ingest": f"select event_id as id, case event_id % 4 when 0 then 'completed' when 3 then 'pending' else 'failed' end as status, nullif(split_part({_ERRORS!r}, ';', cast(event_id % 23 + 1 as int)), '') as error from events",
        "query_log": """
            select item_id as id, trim(text) as t from benchmark union all
            select p_partkey + 100000, trim(concat(case p_partkey % 12 when 0 then 'how to ' when 1 then 'author:' when 2 then '' when 3 then 'a long one about ' when 4 then '"' when 5 then 'tag:x ' when 6 then 'is:unread ' when 7 then 'Author ' when 8 then 'site:"a b" ' when 9 then 'please find ' when 10 then 'Tell me ' else 'showing ' end,
              case p_partkey % 12 when 7 then cast(p_partkey % 40 as string) else p_name end, case p_partkey % 12 when 4 then '"' when 11 then '?' when 1 then ' tag:"two words" after:2024-01-02' when 2 then '.com' else '' end)) from part""",
        "blocks": f"""
            select doc_id, pos, cast(floor(pos / 8) as bigint) as page, line as text, 612.0D0 as width,
              case when doc_id % 3 = 0 and pos % 2 = 1 then 320.0D0 else 40.0D0 end as x0,
              case when doc_id % 3 = 0 and pos % 2 = 1 then 320.0D0 else 40.0D0 end + least(case when doc_id % 3 = 0 then 250 else 530 end, 6 * length(line)) as x1,
              60.0D0 + (pos % 8) * 80 as y0, 120.0D0 + (pos % 8) * 80 as y1
            from (select doc_id, {'posexplode(split(text, chr(10))) as (pos, line)' if d.spark else 'unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line'} from documents where text is not null) b where trim(line) <> ''""".replace("0D0", "0D" if d.spark else "0::double"),
    }


#: Library tables that others are made of, in order.
ORDER = ("items", "live", "users", "vectors", "chunks", "item_vectors", "highlights", "lists", "membership", "entities", "mentions", "relations", "records", "activity", "ingest", "query_log", "blocks")


def needed(sql: str, d: Dialect) -> list[str]:
    """Library tables that a query uses, directly or through others, in order of definition."""
    import re

    all_, found, todo = tables(d), set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in ORDER:
            if name in words and name not in found:
                found.add(name)
                todo.append(all_[name])
    return [x for x in ORDER if x in found]


def with_tables(sql: str, d: Dialect) -> str:
    """The query with the tables that it needs as common table expressions."""
    names = needed(sql, d)
    if not names:
        return sql
    head = ", ".join(f"{x} as ({tables(d)[x]})" for x in names)
    body = sql.lstrip()
    low = body.lower()
    if low.startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if low.startswith("with ") else f"with {head} {body}"


def register(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Temporary views of the raw tables, or of those that ``sql`` names."""
    import re

    words = set(re.findall(r"\w+", sql)) if sql else set(RAW)
    for name in RAW:
        if name in words:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def plain(df: DataFrame) -> DataFrame:
    """Decimals, which literals bring in, as doubles; the library has no decimal column."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if kind.startswith("decimal") else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The answer to a statement over library tables in Spark's dialect."""
    whole = with_tables(sql, Dialect(True))
    register(spark, sf_dir, whole)
    return plain(spark.sql(whole))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A library table as a frame."""
    whole = with_tables(f"select * from {name}", Dialect(True))
    register(spark, sf_dir, whole)
    return spark.sql(whole)
