"""The query catalogue: one query per operator, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bitpack as bp
from ..functions import coerce as co
from ..functions import encoding as en
from ..functions import text as tx
from ..operators import catindex, keytable, pages, postings
from ..operators.ordered import Ordered
from ..operators.project import FieldSpec, TableSpec, merge, project
from ..operators.store import ColumnStore
from ..sources import container
from ..sources.ingest import Source, coerce
from ..steps import at_exit, existing, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(*fields: FieldSpec) -> TableSpec:
    return TableSpec(fields)


ORDERS = _spec(FieldSpec("o_orderkey", rename="order_id"), FieldSpec("o_custkey", rename="customer_id"), FieldSpec("o_orderstatus", skip=True), FieldSpec("o_totalprice", rename="total"))
CUSTOMERS = _spec(FieldSpec("c_custkey", rename="id"), FieldSpec("c_name", encoder="string"), FieldSpec("c_nationkey", rename="nation"), FieldSpec("c_acctbal", skip=True), FieldSpec("c_mktsegment", encoder="string"))

ORDER_PAGES = _spec(FieldSpec("o_orderkey"), FieldSpec("o_custkey"))
BOOKS = _spec(FieldSpec("doc_id"), FieldSpec("text", encoder="string", index=True, index_type="doc_index"))

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINES = _spec(*(FieldSpec(c) for c in LINE_ORDER), *(FieldSpec(c, encoder="string", index=True, index_type="categorical") for c in ("l_returnflag", "l_linestatus")))
PAGE_ROWS = 1000
PHRASE = ["the", "the"]
WANTED = [7, 3, 999_999_999, 7, 42, -1, 11]


def to_columns_project(spark, sf_dir):
    return project(_table(spark, sf_dir, "orders"), ORDERS)


def filtered_push(spark, sf_dir):
    return project(_table(spark, sf_dir, "customer"), CUSTOMERS, ["c_custkey", "c_nationkey", "c_acctbal", "no_such_field"])


def bundle_merge(spark, sf_dir):
    rows = project(_table(spark, sf_dir, "customer"), CUSTOMERS)
    return merge(rows.where("nation < 10"), rows.where("nation >= 5"))


def _cents(name: str) -> F.Column:
    return F.round(F.col(name) * 100).cast("bigint")


def zigzag_width(spark, sf_dir):
    code = en.zigzag(_cents("c_acctbal"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", _cents("c_acctbal").alias("cents"), code.alias("code"), en.bit_width(code).cast("bigint").alias("width"),
        en.clamped_width(en.bit_width(code), "i16").cast("bigint").alias("clamped"), en.unzigzag(code).alias("decoded"),
        en.decode(code, "u8").alias("low_byte"),
    )


def column_bit_width(spark, sf_dir):
    kinds = {"l_orderkey": "u64", "l_partkey": "u32", "l_suppkey": "u32", "l_linenumber": "i32"}
    widths = [en.column_width(F.col(c), k).cast("bigint").alias(f"{c}_width") for c, k in kinds.items()]
    sizes = _table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), *widths)
    return sizes.select(*sizes.columns, en.packed_bytes(F.col("n"), F.col("l_partkey_width")).alias("l_partkey_bytes"))


def delta_encode(spark, sf_dir):
    return Ordered(_table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"]).delta("user_id").select("event_id", "delta")


def delta_roundtrip(spark, sf_dir):
    return Ordered(delta_encode(spark, sf_dir), ["event_id"]).running_sum("delta", "user_id").select("event_id", F.col("user_id").cast("bigint").alias("user_id"))


def pair_struct(spark, sf_dir):
    pairs = _table(spark, sf_dir, "lineitem").select("l_linenumber", en.pair(F.col("l_partkey"), F.col("l_suppkey")).alias("p"))
    a, b = (en.column_width(F.col(f"p.{x}"), "u32").cast("bigint") for x in "ab")
    return pairs.groupBy("l_linenumber").agg(F.count("*").alias("n"), a.alias("a_width"), b.alias("b_width"), F.sum("p.a").alias("a_sum"), F.sum("p.b").alias("b_sum"))


_stores: dict[tuple[str, ...], ColumnStore] = {}


def _stored(spark, sf_dir, table: str, spec: TableSpec, order: list[str]) -> ColumnStore:
    """The table's store: written when a query of this application first asks for it, read by all later ones."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _stores or _stores[key].base not in existing():
        path = new_path(spark)
        _stores[key] = ColumnStore(spark, spec, path).write(_table(spark, sf_dir, table), order, PAGE_ROWS)
        at_exit(path)
    return _stores[key]


def _paged_orders(spark, sf_dir):
    return pages.paged(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], PAGE_ROWS)


def page_stats(spark, sf_dir):
    return pages.page_stats(_paged_orders(spark, sf_dir), "o_orderkey")


def page_skip_scan(spark, sf_dir):
    keep = (F.col("max_value") >= 3000) & (F.col("min_value") < 6000)
    return _stored(spark, sf_dir, "orders", ORDER_PAGES, ["o_orderkey"]).scan("o_orderkey", keep).select("row_pos", "o_orderkey")


def pushdown_filter(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").where("l_quantity >= 45 and l_orderkey between 100 and 5000").select("l_orderkey", "l_quantity")


def _lines(spark, sf_dir):
    columns = list(dict.fromkeys([*LINE_ORDER, "l_returnflag", "l_linestatus"]))
    return Ordered(_table(spark, sf_dir, "lineitem").select(*columns), LINE_ORDER).positions()


def categorical_index(spark, sf_dir):
    at = F.col("row_pos")
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min(at).alias("first_pos"), F.max(at).alias("last_pos"), F.sum(at).alias("pos_sum"))


def categorical_positions(spark, sf_dir):
    rows = Ordered(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"]).positions()
    return catindex.positions_by_value(rows, "s_nationkey").select("s_nationkey", F.array_join("positions", ",").alias("positions"))


def categorical_lookup_or(spark, sf_dir):
    store = _stored(spark, sf_dir, "lineitem", LINES, LINE_ORDER)
    return catindex.cardinality(catindex.any_of(store.categorical("l_returnflag"), ["A", "R"]))


def categorical_lookup_and(spark, sf_dir):
    store = _stored(spark, sf_dir, "lineitem", LINES, LINE_ORDER)
    flags, states = store.categorical("l_returnflag"), store.categorical("l_linestatus")
    return catindex.cardinality(catindex.all_of(catindex.any_of(flags, ["A", "N"]), catindex.any_of(states, ["F"])))


def tokenize_stats(spark, sf_dir):
    return postings.directory(_table(spark, sf_dir, "documents"), "doc_id", "text")


def positional_index(spark, sf_dir):
    index = postings.positional_index(_table(spark, sf_dir, "documents"), "doc_id", "text")
    ends = F.element_at("positions", 1), F.element_at("positions", -1)
    return index.select("doc_id", "token", F.size("positions").cast("bigint").alias("n"), ends[0].cast("bigint").alias("first_pos"), ends[1].cast("bigint").alias("last_pos"))


def phrase_search(spark, sf_dir):
    return postings.search_texts(_table(spark, sf_dir, "documents"), "text", PHRASE).select("doc_id")


def phrase_search_index(spark, sf_dir):
    index = postings.positional_index(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return postings.search_index(index, "doc_id", PHRASE)


def ngram_windows(spark, sf_dir):
    def stats(grams: F.Column) -> F.Column:
        chars = F.aggregate(grams, F.lit(0).cast("bigint"), lambda acc, g: acc + F.length(g))
        return F.struct(F.size(grams).cast("bigint").alias("n"), F.size(F.array_distinct(grams)).cast("bigint").alias("n_distinct"), chars.alias("chars"))

    found = tx.bound_once(tx.windows(tx.tokens(F.col("text")), 3, 2), stats)
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", found.alias("s")).select("doc_id", "s.n", "s.n_distinct", "s.chars")


def document_directory(spark, sf_dir):
    store = _stored(spark, sf_dir, "documents", BOOKS, ["doc_id"])
    return store.directory("text").join(store.rows().select("row_pos", "doc_id"), "row_pos").select("doc_id", "row_pos", "size", "start", "n_tokens", "n_distinct")


def stored_phrase_search(spark, sf_dir):
    store = _stored(spark, sf_dir, "documents", BOOKS, ["doc_id"])
    return store.search("text", PHRASE).join(store.rows().select("row_pos", "doc_id"), "row_pos").select("doc_id")


def packed_values(spark, sf_dir):
    groups = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_partkey").cast("bigint"))).alias("v"))
    packed = groups.select("l_orderkey", "v", bp.encode_values(F.col("v"), "u32").alias("p"))
    back = bp.decode_values(F.col("p"), "u32")
    return packed.select("l_orderkey", F.col("p.width").cast("bigint").alias("width"), F.length("p.bytes").cast("bigint").alias("n_bytes"), F.array_join(back.cast("array<string>"), ",").alias("values"))


def unsigned64_roundtrip(spark, sf_dir):
    value = F.col("o_orderkey").cast("decimal(12,0)") * F.lit(_SPREAD).cast("decimal(20,0)") % F.lit(str(1 << 64)).cast("decimal(20,0)")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", value.cast("decimal(20,0)").alias("v")).withColumn("code", en.from_unsigned(F.col("v")))
    return rows.select("o_orderkey", "code", en.bit_width(F.col("code")).cast("bigint").alias("width"), en.to_unsigned(F.col("code")).cast("string").alias("value"))


def bucketed_get(spark, sf_dir):
    name = "keyed_part_" + "".join(c if c.isalnum() else "_" for c in f"{spark.sparkContext.applicationId}{sf_dir}")
    if not spark.catalog.tableExists(name):
        keytable.write(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload")), name)
    return keytable.multi_get(spark, spark.table(name), "id", "payload", WANTED)


def doc_inverted_index(spark, sf_dir):
    return postings.inverted_index(_table(spark, sf_dir, "documents"), "doc_id", "text")


def token_membership(spark, sf_dir):
    index = postings.inverted_index(_table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = postings.occurrences(_table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "token").distinct()
    return postings.members(asked, "token", index)


def multi_get(spark, sf_dir):
    return keytable.multi_get(spark, _table(spark, sf_dir, "part"), "p_partkey", "p_name", WANTED)


def multi_key_write(spark, sf_dir):
    shared = _table(spark, sf_dir, "part").select(F.array(F.col("p_partkey"), -F.col("p_partkey")).alias("ids"), F.col("p_name").alias("payload"))
    return keytable.share_payload(shared, "ids", "payload")


def bucket_histogram(spark, sf_dir):
    return keytable.bucket_histogram(_table(spark, sf_dir, "orders"), "o_orderkey")


def section_slice(spark, sf_dir):
    url, lit = F.col("url"), F.lit
    return _table(spark, sf_dir, "pages").select(
        "page_id", container.section(url, lit(4), lit(9)).alias("inner"), container.section(url, F.length(url), lit(5)).alias("past_end"),
        container.strict_section(url, F.length(url), F.length(url) - 3, lit(3)).alias("tail"),
    )


_BLANKS = ["null", "''", "' \t '", "' 7 '", "'12'", "'-5'"]


def empty_to_default(spark, sf_dir):
    rows = spark.sql("select * from values " + ", ".join(f"({k}, {v})" for k, v in enumerate(_BLANKS)) + " as t(id, raw)")
    raw = F.col("raw")
    return rows.select("id", co.empty_to_default(raw, "int").alias("as_int"), co.empty_to_default(raw, "double").alias("as_double"), co.empty_to_default(raw, "string").alias("as_text"))


_LISTS = ["[1|2|3]", "1| 2 |x|70000|3", "[]", "", "[5|5]", "[-1|0|65535|65536]"]


def skill_list(spark, sf_dir):
    rows = spark.sql("select * from values " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_LISTS)) + " as t(id, raw)")
    numbers = co.number_list(F.col("raw"))
    return rows.select("id", F.size(numbers).cast("bigint").alias("n"), F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


#: Spreads small keys over all 64 bits.
_SPREAD = 2_862_933_555_777_941_757

_ROWS = [("' 7 '", "''", "'1.5'", "'[1|2| x |70000|3]'", "'  boss '"), ("null", "'3'", "' '", "null", "''"), ("'-2'", "'\t4'", "null", "'5|5'", "'a b'")]
SOURCE = [
    Source("rcid", "int"), Source("next_rcid", "int", "new_rcid"), Source("weight", "double"), Source("skills", "array<int>", "skill_list"),
    Source("title", "string", "title_raw"), Source("mapped_role", "int", None), Source("inflow", "boolean", None),
]


def ingest_rows(spark, sf_dir):
    raw = spark.sql("select * from values " + ", ".join(f"({', '.join(r)})" for r in _ROWS) + " as t(rcid, new_rcid, weight, skill_list, title_raw)")
    return coerce(raw, SOURCE).withColumn("skills", F.array_join(F.col("skills").cast("array<string>"), ","))


_CATALOGUE = [
    to_columns_project, filtered_push, bundle_merge, zigzag_width, column_bit_width, delta_encode, delta_roundtrip, pair_struct, page_stats,
    page_skip_scan, pushdown_filter, categorical_index, categorical_positions, categorical_lookup_or, categorical_lookup_and, tokenize_stats,
    positional_index, phrase_search, phrase_search_index, ngram_windows, doc_inverted_index, token_membership, multi_get, multi_key_write,
    bucket_histogram, section_slice, empty_to_default, skill_list,
    ingest_rows, document_directory, stored_phrase_search, packed_values, unsigned64_roundtrip, bucketed_get,
]


def queries() -> dict:
    return {f.__name__: f for f in _CATALOGUE}


_POS = "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
_TOKENS = "unnest(string_split(text, ' '))"
_ORDINALS = "select doc_id, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents"
_PAGES = f"select o_orderkey, p as row_pos, p // {PAGE_ROWS} as page_id from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as p from orders)"
_STATS = f"select page_id, count(*) as n, min(o_orderkey) as min_value, max(o_orderkey) as max_value from ({_PAGES}) group by page_id"
_CENTS = "select c_custkey, cast(round(c_acctbal * 100) as bigint) as cents from customer"
_CODE = f"select *, case when cents >= 0 then cents * 2 else -cents * 2 - 1 end as code from ({_CENTS})"


def oracle_sql() -> dict[str, str]:
    blanks = ", ".join(f"({k}, {v})" for k, v in enumerate(_BLANKS))
    lists = ", ".join(f"({k}, '{v}')" for k, v in enumerate(_LISTS))
    wanted = ", ".join(f"({k}, {v})" for k, v in enumerate(WANTED))
    return {
        "to_columns_project": "select o_orderkey as order_id, o_custkey as customer_id, o_totalprice as total from orders",
        "filtered_push": "select c_custkey as id, c_nationkey as nation from customer",
        "bundle_merge": "select c_custkey as id, c_name, c_nationkey as nation, c_mktsegment from customer where c_nationkey < 10"
        " union all select c_custkey, c_name, c_nationkey, c_mktsegment from customer where c_nationkey >= 5",
        "zigzag_width": f"select c_custkey, cents, code, length(bin(code)) as width, least(length(bin(code)), 16) as clamped, cents as decoded, code & 255 as low_byte from ({_CODE})",
        "column_bit_width": "select n, ow as l_orderkey_width, pw as l_partkey_width, sw as l_suppkey_width, lw as l_linenumber_width, 4 + cast(ceil(n * pw / 8.0) as bigint) as l_partkey_bytes from"
        " (select count(*) as n, max(length(bin(l_orderkey))) as ow, max(length(bin(l_partkey))) as pw, max(length(bin(l_suppkey))) as sw, max(length(bin(l_linenumber * 2))) as lw from lineitem)",
        "delta_encode": "select event_id, user_id - coalesce(lag(user_id) over (order by event_id), 0) as delta from events",
        "delta_roundtrip": "select event_id, user_id from events",
        "pair_struct": "select l_linenumber, count(*) as n, max(length(bin(l_partkey))) as a_width, max(length(bin(l_suppkey))) as b_width, cast(sum(l_partkey) as bigint) as a_sum,"
        " cast(sum(l_suppkey) as bigint) as b_sum from lineitem group by l_linenumber",
        "page_stats": _STATS,
        "page_skip_scan": f"select row_pos, o_orderkey from ({_PAGES}) where page_id in (select page_id from ({_STATS}) where max_value >= 3000 and min_value < 6000)",
        "pushdown_filter": "select l_orderkey, l_quantity from lineitem where l_quantity >= 45 and l_orderkey between 100 and 5000",
        "categorical_index": f"select l_returnflag, count(*) as n, min(p) as first_pos, max(p) as last_pos, cast(sum(p) as bigint) as pos_sum from (select l_returnflag, {_POS} as p from lineitem) group by 1",
        "categorical_positions": "select s_nationkey, string_agg(cast(p as varchar), ',' order by p) as positions from"
        " (select s_nationkey, row_number() over (order by s_suppkey) - 1 as p from supplier) group by 1",
        "categorical_lookup_or": "select count(*) as n from lineitem where l_returnflag in ('A', 'R')",
        "categorical_lookup_and": "select count(*) as n from lineitem where l_returnflag in ('A', 'N') and l_linestatus = 'F'",
        "tokenize_stats": f"select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct from (select doc_id, {_TOKENS} as token from documents) group by doc_id",
        "positional_index": f"select doc_id, token, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from ({_ORDINALS}) group by doc_id, token",
        "phrase_search": "select doc_id from documents where contains(' ' || text || ' ', ' the the ')",
        "phrase_search_index": "select doc_id from documents where contains(' ' || text || ' ', ' the the ')",
        "ngram_windows": "select doc_id, count(*) as n, count(distinct gram) as n_distinct, cast(sum(length(gram)) as bigint) as chars from (select doc_id, unnest(case when len(t) < 3 then [array_to_string(t, ' ')]"
        " else list_transform(range(1, len(t)), lambda i: array_to_string(list_slice(t, i, i + 2), ' ')) end) as gram from (select doc_id, string_split(text, ' ') as t from documents)) group by doc_id",
        "doc_inverted_index": f"select token, doc_id, count(*) as freq from (select doc_id, {_TOKENS} as token from documents) group by token, doc_id",
        "token_membership": f"select distinct item_id, token from (select item_id, {_TOKENS} as token from benchmark) where token in (select {_TOKENS} from documents)",
        "multi_get": f"select ordinal, w.id, p_partkey is not null as found, p_name as payload from (values {wanted}) w(ordinal, id) left join part on p_partkey = w.id",
        "multi_key_write": "select p_partkey as id, p_name as payload from part union all select -p_partkey, p_name from part",
        "bucket_histogram": "select o_orderkey % ((select count(*) from orders) * 20 // 512 + 1) as bucket, count(*) as n from orders group by 1",
        "section_slice": "select page_id, substr(url, 5, 9) as inner, '' as past_end, right(url, 3) as tail from pages",
        "empty_to_default": f"select id, cast(coalesce(nullif(trim(raw, ' \t'), ''), '0') as int) as as_int, cast(coalesce(nullif(trim(raw, ' \t'), ''), '0') as double) as as_double,"
        f" coalesce(trim(raw, ' \t'), '') as as_text from (values {blanks}) t(id, raw)",
        "ingest_rows": "select cast(coalesce(nullif(trim(rcid, ' \t'), ''), '0') as int) as rcid, cast(coalesce(nullif(trim(new_rcid, ' \t'), ''), '0') as int) as next_rcid,"
        " cast(coalesce(nullif(trim(weight, ' \t'), ''), '0') as double) as weight, coalesce(array_to_string(list_filter(list_transform(string_split(trim(skill_list, '[]'), '|'),"
        " lambda x: try_cast(trim(x) as int)), lambda v: v between 0 and 65535), ','), '') as skills, coalesce(trim(title_raw, ' \t'), '') as title, 0 as mapped_role, false as inflow"
        f" from (values {', '.join(f'({chr(44).join(r)})' for r in _ROWS)}) t(rcid, new_rcid, weight, skill_list, title_raw)",
        "document_directory": "select d.doc_id, row_pos, size, cast(sum(size) over (order by d.doc_id) - size as bigint) as start, n_tokens, n_distinct from (select doc_id,"
        " row_number() over (order by doc_id) - 1 as row_pos, octet_length(encode(text)) as size from documents) d join"
        f" (select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct from (select doc_id, {_TOKENS} as token from documents) group by doc_id) t using (doc_id)",
        "stored_phrase_search": "select doc_id from documents where contains(' ' || text || ' ', ' the the ')",
        "packed_values": "select l_orderkey, max(length(bin(l_partkey))) as width, 4 + cast(ceil(count(*) * max(length(bin(l_partkey))) / 8.0) as bigint) as n_bytes,"
        " string_agg(l_partkey, ',' order by l_partkey) as values from lineitem group by l_orderkey",
        "unsigned64_roundtrip": "select o_orderkey, cast(case when v >= 9223372036854775808 then v - 18446744073709551616 else v end as bigint) as code, length(bin(cast(v as ubigint))) as width,"
        f" cast(v as varchar) as value from (select o_orderkey, o_orderkey::hugeint * {_SPREAD}::hugeint % 18446744073709551616::hugeint as v from orders)",
        "bucketed_get": f"select ordinal, w.id, p_partkey is not null as found, p_name as payload from (values {wanted}) w(ordinal, id) left join part on p_partkey = w.id",
        "skill_list": "select id, len(numbers) as n, array_to_string(numbers, ',') as numbers from (select id, list_filter(list_transform(string_split(trim(raw, '[]'), '|'),"
        f" lambda x: try_cast(trim(x) as int)), lambda v: v between 0 and 65535) as numbers from (values {lists}) t(id, raw))",
    }
