"""The engine's queries over the test tables, each whole, with the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.functions import hashing, sizes
from karstmap.operators import arrays, autofilter, dictionary, filters, lookup, permute
from karstmap.plans import build as plans
from karstmap.plans import inference
from karstmap.sources import generators, storage
from karstmap.streaming.lookup import stream_lookup, windowed_histogram

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def priorities(spark: SparkSession, sf: str) -> DataFrame:
    """D1: each order's priority."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


def skewed(spark: SparkSession, sf: str) -> DataFrame:
    """D2: lines with one common value."""
    lines = table(spark, sf, "lineitem")
    value = F.when(F.col("l_quantity") < 46, 0).otherwise(F.col("l_quantity").cast("bigint") * 100 + F.col("l_linenumber")).cast("bigint")
    return lines.groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")).agg(F.min(value).alias("value"))


D2 = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, min(CASE WHEN l_quantity < 46 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 100 + l_linenumber END) AS value FROM lineitem GROUP BY ALL"


def part_rows(spark: SparkSession, sf: str, skew: bool = False) -> DataFrame:
    """D3: four numbers of each part; D4 with skew: four parts of five have the column's smallest most common one."""
    part = table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    cells = [F.col("p_size").cast("bigint"), brand, F.length("p_type").cast("bigint"), F.length("p_name").cast("bigint")]
    if skew:
        common = F.col("p_partkey") % 5 < 4
        cells = [F.when(common, F.lit(v).cast("bigint")).otherwise(c) for v, c in zip((1, 1, 7, 7), cells, strict=True)]
    return part.select(F.col("p_partkey").alias("key"), F.array(*cells).alias("values"))


D3 = "SELECT p_partkey AS key, [CAST(p_size AS BIGINT), CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), length(p_type), length(p_name)] AS vals FROM part"
D4 = "SELECT p_partkey AS key, CASE WHEN p_partkey % 5 < 4 THEN [1, 1, 7, 7] ELSE [CAST(p_size AS BIGINT), CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), length(p_type), length(p_name)] END AS vals FROM part"


def supplier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """D5: each order's suppliers by line number, part and supplier."""
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(cell)).alias("x"))
    return rows.select("key", F.transform("x", lambda x: x["l_suppkey"]).alias("values"))


D5 = "SELECT l_orderkey AS key, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS vals FROM lineitem GROUP BY l_orderkey"


def cells_sql(rows: str) -> str:
    return f"SELECT key, unnest(generate_series(0, len(vals) - 1)) AS pos, unnest(vals) AS value FROM ({rows})"


def rendered(df: DataFrame, values: str = "values") -> DataFrame:
    """key and the row as text: engines hash lists differently."""
    return df.select("key", F.array_join(F.transform(values, lambda v: v.cast("string")), ",").alias("row"))


def hist_sql(values: str) -> str:
    return f"SELECT value AS symbol, count(*) AS freq FROM ({values}) GROUP BY value"


def lengths_sql(hist: str) -> str:
    """symbol, freq, rn (ascending rank) and code_len: two smallest nodes merge until one is left, leaves before inner ones."""
    return f"""WITH RECURSIVE h AS ({hist}),
r AS (SELECT symbol, freq, row_number() OVER (ORDER BY freq, symbol) AS rn FROM h),
m AS (SELECT 0 AS step, list({{'w': CAST(freq AS BIGINT), 'inner_': 0, 'ord': rn, 'depths': [0]}} ORDER BY freq, rn) AS nodes FROM r
  UNION ALL
  SELECT step + 1, list_sort(list_append(nodes[3:], {{'w': nodes[1].w + nodes[2].w, 'inner_': 1, 'ord': CAST(step AS BIGINT), 'depths': list_transform(list_concat(nodes[1].depths, nodes[2].depths), lambda d: d + 1)}})) FROM m WHERE len(nodes) > 1),
d AS (SELECT nodes[1].depths AS depths FROM m WHERE len(nodes) = 1),
s AS (SELECT list_reverse_sort(depths) AS l FROM d)
SELECT symbol, freq, rn, CAST(greatest(1, l[rn]) AS INT) AS code_len FROM r, s"""


def book_sql(hist: str) -> str:
    """The same with canonical codes: the Kraft sum of the codes before, in the order of length and falling rank."""
    return f"""SELECT symbol, freq, rn, code_len, CAST(coalesce(sum(CAST(pow(2, 40 - code_len) AS BIGINT)) OVER (ORDER BY code_len, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (40 - code_len) AS code FROM ({lengths_sql(hist)})"""


PRIORITY = "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders"
STATS = "sum(freq) AS n, count(*) AS u, max(freq) AS top"


def dominance_sql(hist: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    own = f"{by}, " if by else ""
    return f"SELECT {own}n, u, top, CAST(top AS DOUBLE) / n AS alpha, CAST(u AS DOUBLE) / n AS ratio, n - top AS minority FROM (SELECT {own}{STATS} FROM ({hist}) {group})"


def grid_sql(stats: str) -> str:
    """Every candidate of the bound for each row of statistics."""
    return f"""SELECT s.*, c.ord, c.kind, c.bits, c.hashes,
1.089 * alpha * (1 - eps) - ratio - (CASE kind WHEN 'xor' THEN 1.23 * bits WHEN 'binary_fuse' THEN (CASE WHEN minority <= 1 THEN 1.075 ELSE greatest(1.075, 0.77 + 0.305 * ln(600000.0) / ln(greatest(CAST(minority AS DOUBLE), 2.0))) END) * bits ELSE bits END) * (1 - alpha) AS lb
FROM ({stats}) s, (
SELECT b AS ord, 'xor' AS kind, b AS bits, 0 AS hashes, pow(2.0, -b) AS eps FROM range(1, 9) t(b)
UNION ALL SELECT 8 + b, 'binary_fuse', b, 0, pow(2.0, -b) FROM range(1, 9) t(b)
UNION ALL SELECT 16 + (k - 1) * 8 + b, 'bloom', b, k, pow(1 - exp(-CAST(k AS DOUBLE) / b), k) FROM range(1, 9) t(b), range(1, 9) u(k)) c"""


def md5_word(expr: str, part: int) -> str:
    return f"CAST(('0x' || substr(md5({expr}), {8 * part + 1}, 8)) AS BIGINT)"


# --- lookups


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return plans.build(priorities(spark, sf), tier="relational", prefilter=None).at(42).select(F.col("key").cast("bigint").alias("key"), "value")


BATCH = "SELECT DISTINCT l_orderkey AS key, o_orderpriority AS value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()


@query(BATCH)
def batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.joined(probes(spark, sf), priorities(spark, sf), "key")


@query(BATCH)
def batch_lookup_mcv_elided(spark: SparkSession, sf: str) -> DataFrame:
    pairs = priorities(spark, sf)
    mcv = dictionary.most_common(dictionary.histogram(pairs)).first()["mcv"]
    return lookup.joined_or(probes(spark, sf), lookup.minority(pairs, mcv), mcv, "key")


@query(BATCH)
def hash_map_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.joined(probes(spark, sf), lookup.hash_map(priorities(spark, sf)), "key")


@query(BATCH)
def compact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return plans.build(priorities(spark, sf)).lookup(probes(spark, sf))


@query(f"SELECT key, value FROM ({D2})")
def compact_lookup_filtered(spark: SparkSession, sf: str) -> DataFrame:
    pairs = skewed(spark, sf)
    return plans.build(pairs).lookup(pairs.select("key"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL")
def string_value_lookup(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    index = plans.build(customer, "c_custkey", "c_mktsegment", tier="relational")
    return index.lookup(customer.select("c_custkey"), "c_custkey").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return inference.repeated_keys(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key"))


# --- statistics and codes


@query("SELECT o_orderpriority AS symbol, count(*) AS freq FROM orders GROUP BY ALL")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.histogram(priorities(spark, sf))


@query(f"SELECT CAST(pos AS INT) AS pos, symbol AS mcv, freq FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY freq DESC, symbol) AS r FROM (SELECT pos, value AS symbol, count(*) AS freq FROM ({cells_sql(D3)}) GROUP BY ALL)) WHERE r = 1")
def most_common_value(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.most_common(dictionary.column_histogram(part_rows(spark, sf)), ["pos"])


@query(f"SELECT CAST(n AS BIGINT) AS n_keys, u AS n_unique, top, round(alpha, 9) AS alpha, round(ratio, 9) AS distinct_ratio, CAST(minority AS BIGINT) AS n_minority FROM ({dominance_sql(hist_sql(D2))})")
def dominance_stats(spark: SparkSession, sf: str) -> DataFrame:
    own = dictionary.dominance(dictionary.histogram(skewed(spark, sf)))
    return own.withColumn("alpha", F.round("alpha", 9)).withColumn("distinct_ratio", F.round("distinct_ratio", 9))


@query(f"SELECT CAST(pos AS INT) AS pos, round(log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq), 6) AS entropy_bits FROM (SELECT pos, value, count(*) AS freq FROM ({cells_sql(D4)}) GROUP BY ALL) GROUP BY pos")
def column_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.entropy(dictionary.column_histogram(part_rows(spark, sf, skew=True)), ["pos"]).withColumn("entropy_bits", F.round("entropy_bits", 6))


BRANDS = "SELECT p_brand AS value FROM part"


@query(f"SELECT symbol, freq, code_len FROM ({lengths_sql(hist_sql(BRANDS))})")
def huffman_code_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.codebook(dictionary.histogram(table(spark, sf, "part"), "p_brand")).select("symbol", "freq", "code_len")


@query(f"SELECT symbol, code_len, code FROM ({book_sql(hist_sql(D2))})")
def canonical_codes(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.codebook(dictionary.histogram(skewed(spark, sf))).select("symbol", "code_len", "code")


@query(f"SELECT code_len, count(*) AS symbols FROM ({lengths_sql(hist_sql(D2))}) GROUP BY code_len")
def code_length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.codebook(dictionary.histogram(skewed(spark, sf))).groupBy("code_len").agg(F.count("*").alias("symbols"))


@query(f"SELECT CAST(sum(freq * code_len) AS BIGINT) AS total_bits, round(CAST(sum(freq * code_len) AS DOUBLE) / sum(freq), 6) AS avg_bits_per_key, round(avg(code_len), 6) AS avg_bits_per_symbol, max(code_len) AS max_code_length FROM ({lengths_sql(hist_sql(D2))})")
def encoded_bits(spark: SparkSession, sf: str) -> DataFrame:
    own = dictionary.encoded_bits(dictionary.codebook(dictionary.histogram(skewed(spark, sf))))
    return own.withColumn("avg_bits_per_key", F.round("avg_bits_per_key", 6)).withColumn("avg_bits_per_symbol", F.round("avg_bits_per_symbol", 6))


@query(f"SELECT key, value FROM ({D2})")
def codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    pairs = skewed(spark, sf)
    book = dictionary.codebook(dictionary.histogram(pairs))
    return dictionary.decoded(dictionary.encoded(pairs, book).drop("value"), book).select("key", "value")


@query(f"SELECT symbol, freq FROM (SELECT value AS symbol, count(*) AS freq FROM ({cells_sql(D3)}) GROUP BY value)")
def pooled_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.pooled_histogram(part_rows(spark, sf))


def number_sql(name: str, value: str) -> str:
    return f"SELECT '{name}' AS column_name, CASE WHEN max({value}) <= 4294967295 THEN 'uint32' ELSE 'uint64' END AS kind FROM orders"


def text_sql(name: str, value: str) -> str:
    return f"SELECT '{name}', CASE WHEN min(strlen({value})) = max(strlen({value})) AND max(strlen({value})) IN (10, 12) THEN 'char' || max(strlen({value})) ELSE 'string' END FROM orders"


@query(" UNION ALL ".join([number_sql("o_orderkey", "o_orderkey"), number_sql("big", "CAST(o_orderkey AS HUGEINT) * 1000000000000"), text_sql("char10", "rpad(o_orderstatus, 10, ' ')"), text_sql("char12", "rpad(o_orderstatus, 12, ' ')"), text_sql("o_orderpriority", "o_orderpriority")]))
def backend_inference(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    big = (F.col("o_orderkey").cast("decimal(20,0)") * 10**12).cast("decimal(20,0)")
    own = orders.select("o_orderkey", big.alias("big"), F.rpad("o_orderstatus", 10, " ").alias("char10"), F.rpad("o_orderstatus", 12, " ").alias("char12"), "o_orderpriority")
    return spark.createDataFrame([(c, inference.infer(own, c).kind) for c in own.columns], "column_name string, kind string")


# --- buckets


EQUATIONS = f"SELECT CAST(sum(freq * code_len) AS BIGINT) AS equations, CAST(sum(freq) AS BIGINT) AS keys FROM ({lengths_sql(hist_sql(D2))})"


@query(f"SELECT least(greatest(equations // 3500, keys // 1000 + 1), keys // 100 + 1) AS buckets, greatest(equations // 3500, keys // 1000 + 1) AS packed FROM ({EQUATIONS})")
def target_bucket_count(spark: SparkSession, sf: str) -> DataFrame:
    book = dictionary.codebook(dictionary.histogram(skewed(spark, sf)))
    own = book.agg(F.sum(F.col("freq") * F.col("code_len")).alias("equations"), F.sum("freq").alias("keys"))
    return own.select(sizes.target_buckets(F.col("equations"), F.col("keys")).alias("buckets"), sizes.packed_buckets(F.col("equations"), F.col("keys")).alias("packed"))


BUCKET_SQL = f"({md5_word(chr(39) + '0:' + chr(39) + ' || o_orderkey', 0)} * 16) >> 32"


@query(f"SELECT o_orderkey AS key, {BUCKET_SQL} AS bucket FROM orders")
def bucket_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return priorities(spark, sf).select("key", hashing.bucket_of("key", 16).alias("bucket"))


@query(f"""WITH b AS ({lengths_sql(hist_sql(PRIORITY))}), e AS (SELECT {BUCKET_SQL} AS bucket, sum(code_len) AS eq, max(code_len) AS longest FROM orders JOIN b ON o_orderpriority = symbol GROUP BY 1),
s AS (SELECT CAST(ceil(eq * 1.089) AS BIGINT) + (SELECT max(code_len) FROM b) AS bits FROM e)
SELECT count(*) AS num_buckets, CAST(sum(bits) AS BIGINT) AS total_solution_bits, round(avg(bits), 6) AS avg_solution_bits, min(bits) AS min_solution_bits, max(bits) AS max_solution_bits FROM s""")
def bucket_stats(spark: SparkSession, sf: str) -> DataFrame:
    pairs = priorities(spark, sf)
    book = dictionary.codebook(dictionary.histogram(pairs))
    longest = book.agg(F.max("code_len").alias("longest"))
    own = dictionary.encoded(pairs, book).groupBy(hashing.bucket_of("key", 16).alias("bucket")).agg(F.sum("code_len").alias("eq"))
    bits = own.join(F.broadcast(longest)).select(sizes.solution_bits(F.col("eq"), F.col("longest")).alias("bits"))
    return bits.agg(F.count("*").alias("num_buckets"), F.sum("bits").alias("total_solution_bits"), F.round(F.avg("bits"), 6).alias("avg_solution_bits"), F.min("bits").alias("min_solution_bits"), F.max("bits").alias("max_solution_bits"))


@query(f"""WITH b AS ({lengths_sql(hist_sql(PRIORITY))}), e AS (SELECT {BUCKET_SQL} AS bucket, sum(code_len) AS eq FROM orders JOIN b ON o_orderpriority = symbol GROUP BY 1),
s AS (SELECT CAST(ceil(eq * 1.089) AS BIGINT) + (SELECT max(code_len) FROM b) AS bits FROM e)
SELECT CAST(sum((bits + 63) // 64 * 8) AS BIGINT) AS solution_bytes, CAST(4 * ((SELECT max(code_len) FROM b) + 1) + 8 * (SELECT count(*) FROM b) + 8 + 17 * count(*) AS BIGINT) AS metadata_bytes FROM s""")
def memory_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    pairs = priorities(spark, sf)
    book = dictionary.codebook(dictionary.histogram(pairs))
    shape = book.agg(F.max("code_len").alias("longest"), F.count("*").alias("symbols"))
    own = dictionary.encoded(pairs, book).groupBy(hashing.bucket_of("key", 16).alias("bucket")).agg(F.sum("code_len").alias("eq"))
    bits = own.join(F.broadcast(shape)).withColumn("bits", sizes.solution_bits(F.col("eq"), F.col("longest")))
    solution = F.sum(F.floor((F.col("bits") + 63) / 64) * 8).cast("bigint")
    metadata = (4 * (F.max("longest") + 1) + 8 * F.max("symbols") + 8 + sizes.BUCKET_METADATA_BYTES * F.count("*")).cast("bigint")
    return bits.agg(solution.alias("solution_bytes"), metadata.alias("metadata_bytes"))


# --- prefilters


@query(f"SELECT CAST(ord AS INT) AS ord, kind, CAST(bits AS INT) AS bits, CAST(hashes AS INT) AS hashes, round(lb, 9) AS lb FROM ({grid_sql(dominance_sql(hist_sql(D2)))})")
def autofilter_candidates(spark: SparkSession, sf: str) -> DataFrame:
    own = autofilter.candidates(dictionary.dominance(dictionary.histogram(skewed(spark, sf))))
    return own.select("ord", "kind", "bits", "hashes", F.round("lb", 9).alias("lb"))


CHOICES = f"SELECT 'skewed' AS name, value FROM ({D2}) UNION ALL SELECT 'toxic', CAST(toxic AS BIGINT) FROM labels UNION ALL SELECT 'quality', CAST(quality AS BIGINT) FROM labels UNION ALL SELECT 'size', CAST(p_size AS BIGINT) FROM part"
CHOICE_STATS = dominance_sql(f"SELECT name, value, count(*) AS freq FROM ({CHOICES}) GROUP BY ALL", "name")


@query(f"SELECT name, CASE WHEN pays THEN kind ELSE 'none' END AS kind, CAST(CASE WHEN pays THEN bits ELSE 0 END AS INT) AS bits, CAST(CASE WHEN pays THEN hashes ELSE 0 END AS INT) AS hashes, round(lb, 9) AS lb FROM (SELECT *, lb > 0 AND alpha < 1 AND minority > 10 AS pays, row_number() OVER (PARTITION BY name ORDER BY round(lb, 12) DESC, ord) AS r FROM ({grid_sql(CHOICE_STATS)})) WHERE r = 1")
def autofilter_choice(spark: SparkSession, sf: str) -> DataFrame:
    labels, part = table(spark, sf, "labels"), table(spark, sf, "part")
    own = skewed(spark, sf).select(F.lit("skewed").alias("name"), "value")
    for name, df, c in (("toxic", labels, "toxic"), ("quality", labels, "quality"), ("size", part, "p_size")):
        own = own.union(df.select(F.lit(name), F.col(c).cast("bigint")))
    hist = own.groupBy("name", F.col("value").alias("symbol")).agg(F.count("*").alias("freq"))
    return autofilter.choices(dictionary.dominance(hist, ["name"]), ["name"]).withColumn("lb", F.round("lb", 9))


MINORITY = f"SELECT key, value FROM ({D2}) WHERE value <> 0"
ODD = f"({md5_word(chr(39) + '1:' + chr(39) + ' || key', 1)})"
PLACES = f"list_transform(range(0, 5), lambda i: (({md5_word(chr(39) + '1:' + chr(39) + ' || key', 0)}) + i * (CASE WHEN {ODD} % 2 = 1 THEN {ODD} ELSE {ODD} + 1 END)) % m)"
BLOOM = f"SELECT DISTINCT unnest({PLACES}) AS bit FROM ({MINORITY}), (SELECT 6 * count(*) AS m FROM ({MINORITY}))"


def rare(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.minority(skewed(spark, sf), 0)


@query(f"SELECT key, value FROM ({D2}) WHERE value <> 0")
def minority_keys(spark: SparkSession, sf: str) -> DataFrame:
    return rare(spark, sf)


@query(f"SELECT key, CAST(CASE WHEN value = 0 THEN 0 ELSE 1 END AS INT) AS value FROM ({D2})")
def sentinel_projection(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.sentinels(skewed(spark, sf), 0)


@query(f"SELECT key, value FROM ({D2}) WHERE value <> 0")
def filter_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """The minority's rows that a filter accepts after it was saved and loaded: all of them."""
    path = _scratch(spark)
    filters.save(filters.make_filter(rare(spark, sf), filters.XORFilterConfig(8)), path)
    return filters.load(spark, path).survivors(rare(spark, sf))


@query(BLOOM)
def bloom_bits(spark: SparkSession, sf: str) -> DataFrame:
    return filters.BloomFilter.of(rare(spark, sf), filters.BloomFilterConfig(6, 5)).bits


@query(f"WITH b AS MATERIALIZED (SELECT list(bit) AS bits FROM ({BLOOM})), k AS (SELECT key, value, unnest({PLACES}) AS bit FROM ({D2}), (SELECT 6 * count(*) AS m FROM ({MINORITY}))) SELECT key, value FROM k LEFT JOIN (SELECT unnest(bits) AS bit, 1 AS found FROM b) USING (bit) GROUP BY key, value HAVING count(found) = count(*)")
def bloom_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return filters.BloomFilter.of(rare(spark, sf), filters.BloomFilterConfig(6, 5)).survivors(skewed(spark, sf))


def _missed(spark: SparkSession, sf: str, config: filters.FilterConfig) -> DataFrame:
    made = filters.make_filter(rare(spark, sf), config)
    return made.marked(rare(spark, sf).select("key")).agg(F.count("*").alias("n_minority"), F.count_if(~F.col("__in")).alias("n_rejected"))


MISSED = f"SELECT count(*) AS n_minority, CAST(0 AS BIGINT) AS n_rejected FROM ({MINORITY})"


@query(MISSED)
def xor_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _missed(spark, sf, filters.XORFilterConfig(8))


@query(MISSED)
def fuse_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _missed(spark, sf, filters.BinaryFuseFilterConfig(8))


@query(f"""WITH n AS (SELECT count(*) AS n FROM ({MINORITY})), l AS (SELECT n, least(CAST(pow(2, greatest(0, floor(ln(n) / ln(2.91) - 0.5))) AS BIGINT), 262144) AS seg, CAST(floor(n * greatest(1.075, 0.77 + 0.305 * ln(600000) / ln(n))) AS BIGINT) AS cells FROM n)
SELECT 'xor' AS kind, 8 * (3 * ((32 + CAST(floor(1.23 * n) AS BIGINT)) // 3)) AS bits FROM l UNION ALL SELECT 'binary_fuse', 8 * (greatest(1, (cells + seg - 1) // seg - 3) + 3) * seg FROM l UNION ALL SELECT 'bloom', 6 * n FROM l""")
def filter_memory(spark: SparkSession, sf: str) -> DataFrame:
    n = rare(spark, sf).count()
    rows = [("xor", 8 * (3 * (sizes.xor_cells(n) // 3))), ("binary_fuse", 8 * sizes.fuse_layout(n)[2]), ("bloom", 6 * n)]
    return spark.createDataFrame(rows, "kind string, bits bigint")


# --- arrays


RENDERED = "SELECT key, array_to_string(vals, ',') AS row FROM ({})"


@query(RENDERED.format(D3))
def fixed_array_lookup(spark: SparkSession, sf: str) -> DataFrame:
    own = part_rows(spark, sf)
    return rendered(plans.build(own, "key", "values").lookup(own.select("key"), out="values"))


MCVS = f"SELECT pos, symbol AS mcv FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY freq DESC, symbol) AS r FROM (SELECT pos, value AS symbol, count(*) AS freq FROM ({cells_sql(D4)}) GROUP BY ALL)) WHERE r = 1"


@query(f"SELECT mcv, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM ({MCVS}) GROUP BY mcv")
def column_mcv_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = arrays.column_groups(dictionary.column_histogram(part_rows(spark, sf, skew=True)))
    return groups.select("mcv", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"SELECT m.mcv, c.key, bool_or(c.value <> m.mcv) AS is_minority FROM ({cells_sql(D4)}) c JOIN ({MCVS}) m USING (pos) GROUP BY ALL")
def shared_filter_minority(spark: SparkSession, sf: str) -> DataFrame:
    own = part_rows(spark, sf, skew=True)
    return arrays.group_minority(own, arrays.column_groups(dictionary.column_histogram(own)))


@query(f"""WITH RECURSIVE c AS (SELECT pos, count(DISTINCT value) AS n FROM ({cells_sql(D4)}) GROUP BY pos), o AS (SELECT *, row_number() OVER (ORDER BY n, pos) AS r FROM c),
f AS (SELECT r, pos, n, n AS least, 1 AS g FROM o WHERE r = 1 UNION ALL SELECT o.r, o.pos, o.n, CASE WHEN o.n > 2 * f.least THEN o.n ELSE f.least END, CASE WHEN o.n > 2 * f.least THEN f.g + 1 ELSE f.g END FROM f JOIN o ON o.r = f.r + 1)
SELECT CAST(pos AS INT) AS pos, n AS n_buckets, CAST(g AS INT) AS subgroup FROM f""")
def bucket_subgroups(spark: SparkSession, sf: str) -> DataFrame:
    hist = dictionary.column_histogram(part_rows(spark, sf, skew=True))
    return arrays.bucket_subgroups(hist.groupBy("pos").agg(F.count("*").alias("n_buckets")))


@query(f"SELECT key, CAST(len(vals) AS BIGINT) AS length FROM ({D5})")
def ragged_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.lengths(supplier_rows(spark, sf))


@query(f"SELECT CAST(pos AS INT) AS pos, count(*) AS n_keys FROM ({cells_sql(D5)}) GROUP BY pos")
def ragged_column_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.column_sizes(supplier_rows(spark, sf))


@query(RENDERED.format(D5))
def ragged_lookup(spark: SparkSession, sf: str) -> DataFrame:
    own = supplier_rows(spark, sf)
    return rendered(plans.build(own, "key", "values").lookup(own.select("key"), out="values"))


@query(f"SELECT key, array_to_string(list_concat(vals, list_transform(range(0, m - len(vals)), lambda x: 0)), ',') AS row FROM ({D5}), (SELECT max(len(vals)) AS m FROM ({D5}))")
def padded_array(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(arrays.padded(supplier_rows(spark, sf)))


PACKED_HIST = f"SELECT value AS symbol, count(*) AS freq FROM (SELECT value FROM ({cells_sql(D5)}) UNION ALL SELECT -1 FROM ({D5})) GROUP BY value"


@query(f"WITH b AS ({lengths_sql(PACKED_HIST)}) SELECT key, CAST(sum(code_len) AS BIGINT) AS n_bits FROM (SELECT key, value FROM ({cells_sql(D5)}) UNION ALL SELECT key, -1 FROM ({D5})) JOIN b ON symbol = value GROUP BY key")
def packed_bits_per_key(spark: SparkSession, sf: str) -> DataFrame:
    own = supplier_rows(spark, sf)
    return arrays.packed_rows(own, dictionary.codebook(arrays.packed_histogram(own))).select("key", "n_bits")


@query(f"WITH b AS ({lengths_sql(PACKED_HIST)}), r AS (SELECT key, sum(code_len) AS n FROM (SELECT key, value FROM ({cells_sql(D5)}) UNION ALL SELECT key, -1 FROM ({D5})) JOIN b ON symbol = value GROUP BY key) SELECT CAST((SELECT max(n) FROM r) + (SELECT max(code_len) FROM b) AS BIGINT) AS max_total_bits")
def packed_max_bits(spark: SparkSession, sf: str) -> DataFrame:
    own = supplier_rows(spark, sf)
    book = dictionary.codebook(arrays.packed_histogram(own)).persist()
    return arrays.most_bits(arrays.packed_rows(own, book), book)


@query(RENDERED.format(D5))
def packed_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    own = supplier_rows(spark, sf)
    book = dictionary.codebook(arrays.packed_histogram(own)).persist()
    return rendered(arrays.unpacked_rows(arrays.packed_rows(own, book), book))


# --- permutations


SORTED = f"SELECT key, list(value ORDER BY n DESC, value) AS vals FROM ({cells_sql(D5)}) JOIN (SELECT value, count(*) AS n FROM ({cells_sql(D5)}) GROUP BY value) USING (value) GROUP BY key"
ENTROPY = "SELECT sum(h) AS bits FROM (SELECT log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq) AS h FROM (SELECT pos, value, count(*) AS freq FROM ({}) GROUP BY ALL) GROUP BY pos)"


@query(RENDERED.format(SORTED))
def global_sort_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(permute.global_sort(supplier_rows(spark, sf)))


@query(f"SELECT 'before' AS stage, round(bits, 6) AS bits FROM ({ENTROPY.format(cells_sql(D5))}) UNION ALL SELECT 'after', round(bits, 6) FROM ({ENTROPY.format(cells_sql(SORTED))})")
def permuted_column_entropy(spark: SparkSession, sf: str) -> DataFrame:
    own = supplier_rows(spark, sf)
    out = None
    for stage, rows in (("before", own), ("after", permute.global_sort(own))):
        bits = dictionary.entropy(dictionary.column_histogram(rows), ["pos"]).agg(F.round(F.sum("entropy_bits"), 6).alias("bits")).select(F.lit(stage).alias("stage"), "bits")
        out = bits if out is None else out.union(bits)
    return out


SAME = "SELECT key, array_to_string(list_sort(vals), ',') AS row FROM ({})"


@query(SAME.format(D5))
def refine_multiset_preserved(spark: SparkSession, sf: str) -> DataFrame:
    own = permute.permuted(supplier_rows(spark, sf), permute.GlobalSortPermutationConfig(5))
    return rendered(own.withColumn("values", F.array_sort("values")))


@query("SELECT key, array_to_string(list_sort(vals), ',') AS row FROM (SELECT n_regionkey AS key, list(CAST(length(n_name) AS BIGINT)) AS vals FROM nation GROUP BY n_regionkey)")
def entropy_permutation_preserved(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_list(F.length("n_name").cast("bigint")).alias("values"))
    return rendered(permute.permuted(own, permute.EntropyPermutationConfig()).withColumn("values", F.array_sort("values")))


# --- sources, sinks and streams


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="karstmap-")  # one machine
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("SELECT count(*) AS n_keys, CAST(0 AS BIGINT) AS n_different FROM orders")
def save_load_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    pairs = priorities(spark, sf)
    path = _scratch(spark)
    plans.build(pairs).save(path)
    back = plans.load(spark, path, "scalar-string").lookup(pairs.select("key"))
    return back.join(pairs.withColumnRenamed("value", "own"), "key").agg(F.count("*").alias("n_keys"), F.count_if(~F.col("value").eqNullSafe(F.col("own"))).alias("n_different"))


@query("SELECT event_id, e.user_id, c_mktsegment AS value FROM events e LEFT JOIN customer ON user_id = c_custkey")
def stream_static_lookup(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return _streamed(spark, sf, lambda s: stream_lookup(s, customers, "user_id", out="segment").select("event_id", "user_id", F.col("segment").alias("value")))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type AS symbol, count(*) AS freq FROM events GROUP BY ALL")
def stream_window_histogram(spark: SparkSession, sf: str) -> DataFrame:
    zone = spark.conf.get("spark.sql.session.timeZone")  # the column has no zone and is taken as UTC in any session
    own = _streamed(spark, sf, lambda s: windowed_histogram(s.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)), "ts", "event_type", "1 day", "36500 days"), "complete")
    return own.withColumn("window_start", F.date_format(F.to_utc_timestamp("window_start", zone), "yyyy-MM-dd"))


def _streamed(spark: SparkSession, sf: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream over the events table has written when it has read all; a sink keeps the last batch of complete results."""
    path = _scratch(spark)
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")  # a file or a folder
    out = plan(stream)
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")
    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query()
def generated_rows(spark: SparkSession, sf: str) -> DataFrame:
    return generators.distinct_rows(spark, 500, 8, 100, "zipf").select("key", F.size("values").alias("n"), F.size(F.array_distinct("values")).alias("n_distinct"))


@query()
def generated_mix(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dominance(dictionary.histogram(generators.alpha_mix(spark, 10_000, 0.9, "uniform_100")))


@query("SELECT count(*) AS n_before, count(*) AS n_after, CAST(0 AS BIGINT) AS n_different FROM part")
def table_save_load(spark: SparkSession, sf: str) -> DataFrame:
    own = rendered(part_rows(spark, sf))
    path = _scratch(spark)
    storage.save(spark, path, {"kind": "rows"}, {"rows": own})
    back = storage.load(spark, path, "rows")[1]["rows"]
    return spark.createDataFrame([(own.count(), back.count(), storage.difference(own, back))], "n_before bigint, n_after bigint, n_different bigint")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: orders become an index, each line's order asks it, lines are counted by priority."""
    index = plans.build(priorities(spark, sf), tier="relational")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return index.lookup(lines).groupBy("value").agg(F.count("*").alias("n_lines"))


@query("SELECT o_orderpriority AS value, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def lines_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return entry(spark, sf)
