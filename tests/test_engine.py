"""Codes, filters, the compact tier, layouts, permutations, storage and errors on fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql.functions import col as k_col
from pyspark.sql.functions import lit as k_lit
from hypothesis import given, settings
from hypothesis import strategies as st

import karstmap as k
from karstmap.functions import bits, sizes
from karstmap.operators import arrays, autofilter, compact, dictionary, filters, permute
from karstmap.plans import inference
from karstmap.sources import generators, storage

KEYS = [f"key{i}" for i in range(1000)]


def check(spark, keys, values, **options):
    index = k.from_lists(spark, keys, values, **options)
    got = index.query_batch(list(keys))
    assert got == [list(v) if isinstance(v, (list, tuple)) else v for v in values]
    return index


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_code_lengths_are_optimal(freqs):
    freqs = sorted(freqs)
    lengths = dictionary.code_lengths(freqs)
    assert lengths == sorted(lengths, reverse=True) and sum(2.0**-x for x in lengths) == (1 if len(freqs) > 1 else 0.5)
    import heapq

    heap, cost = list(freqs), 0 if len(freqs) > 1 else freqs[0]
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert sum(f * n for f, n in zip(freqs, lengths, strict=True)) == cost


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=30))
def test_cells(width, values):
    own = np.array(values, np.uint64) & np.uint64((1 << width) - 1)
    assert (bits.unpack_cells(bits.pack_cells(own, width), width, len(own)) == own).all()


@pytest.mark.parametrize("tier", ["compact", "relational"])
@pytest.mark.parametrize("values", [list(range(1000)), [5] * 900 + list(range(100)), [7] * 1000, [f"value{i % 50}" for i in range(1000)], [f"{i % 9:010d}" for i in range(1000)], [i << 40 for i in range(1000)]], ids=["unique", "skewed", "constant", "string", "char10", "uint64"])
def test_scalar(spark, tier, values):
    index = check(spark, KEYS, values, tier=tier)
    kind = "uint64" if values[-1] == 999 << 40 else "uint32" if isinstance(values[0], int) else "char10" if len(values[0]) == 10 else "string"
    assert not index.is_multiset() and index.kind == kind


def test_forced_kinds(spark):
    assert k.from_lists(spark, ["a", "b"], [1, 2], kind_of_values="uint64").kind == "uint64"
    assert k.from_lists(spark, ["a", "b"], ["0123456789", "9876543210"], kind_of_values="string").query("b") == "9876543210"
    for values, wanted in (([1 << 40, 2], "uint32"), (["x", "y"], "char10"), ([1, 2], "string"), ([1, 2], "int8")):
        with pytest.raises(ValueError):
            k.from_lists(spark, ["a", "b"], values, kind_of_values=wanted)


def test_one_key(spark):
    for options in ({"tier": "relational", "prefilter": None}, {"tier": "relational"}, {}):
        index = k.from_lists(spark, [f"k{i}" for i in range(50)], [i % 7 for i in range(50)], **options)
        assert [(r.key, r.value) for r in index.at(b"k9").collect()] == [("k9", 2)]


def test_npy(spark, tmp_path):
    from karstmap.sources import storage

    matrix = np.arange(12, dtype=np.uint32).reshape(4, 3)
    np.save(tmp_path / "a.npy", matrix)
    rows = storage.read_npy(spark, str(tmp_path)).orderBy("row").collect()
    assert [r["values"] for r in rows] == matrix.tolist() and [r["row"] for r in rows] == [0, 1, 2, 3]


def test_filters_alone(spark, tmp_path):
    from karstmap.operators import filters

    keys = spark.range(500).selectExpr("concat('k', id) AS key")
    for i, config in enumerate((k.BloomFilterConfig(10, 4), k.XORFilterConfig(8), k.BinaryFuseFilterConfig(9))):
        made = filters.make_filter(keys, config)
        filters.save(made, f"file://{tmp_path}/{i}")
        back = filters.load(spark, f"file://{tmp_path}/{i}")
        assert back.stats() == made.stats() and back.survivors(keys).count() == 500


def test_code_bits(spark):
    codes = [(0b1011, 4), (0, 3), (1, 1), ((1 << 62) - 1, 62)]
    df = spark.createDataFrame(codes, "code long, length int")
    shown = df.select(bits.rendered(k_col("code"), k_col("length")).alias("s"), bits.bit(k_col("code"), k_col("length"), k_lit(0)).alias("first"), bits.distance(k_col("code"), k_lit(1)).alias("d")).collect()
    assert [r.s for r in shown] == [f"{c:0{n}b}" for c, n in codes]
    assert [r["first"] for r in shown] == [c >> (n - 1) & 1 for c, n in codes] and [r.d for r in shown] == [(c ^ 1).bit_count() for c, _ in codes]


@pytest.mark.parametrize("config", [None, k.BloomFilterConfig(10, 7), k.XORFilterConfig(8), k.XORFilterConfig(4), k.BinaryFuseFilterConfig(12)], ids=str)
def test_filters_keep_values(spark, config):
    values = [0] * 800 + list(range(200))
    index = check(spark, KEYS, values, prefilter=config)
    stats = index.get_stats()["filter_stats"]
    if config is not None:
        assert stats["num_elements"] == 199
    if isinstance(config, k.BloomFilterConfig):
        assert stats["size_bits"] == 1990 and stats["num_hashes"] == 7


def test_arrays(spark, tmp_path):
    fixed = [[i + j for j in range(4)] for i in range(300)]
    ragged = [[i % 7] * (i % 4) for i in range(300)]
    for values, options, layout in ((fixed, {}, "fixed"), (ragged, {}, "ragged"), (ragged, {"strategy": "packed"}, "packed"), (fixed, {"tier": "relational", "shared_codebook": True}, "fixed"), ([[4294967295, 1]] * 300, {"strategy": "packed"}, "packed")):
        index = check(spark, KEYS[:300], values, **options)
        assert index.layout == layout and index.is_multiset()
        index.save(f"{tmp_path}/{layout}")
        back = k.load(spark, f"{tmp_path}/{layout}")
        assert back.query_batch(KEYS[:300]) == values
    mixed = k.from_lists(spark, KEYS[:300], [list(np.random.default_rng(i).permutation(6)) for i in range(300)], permutation=k.GlobalSortPermutationConfig(2))
    assert all(sorted(v) == list(range(6)) for v in mixed.query_batch(KEYS[:300]))


def test_column_codes(spark, tmp_path):
    """Each column has a code and a most common value of its own, which takes fewer bits than one code for all."""
    draw = np.random.default_rng(4)
    rows = [[int(i % 10 == 0), 100 + int(draw.integers(8)), 7, 50 if draw.random() < 0.97 else int(draw.integers(50))][: 4 - i % 2] for i in range(1000)]
    fixed = [r + [50] * (4 - len(r)) for r in rows]
    bits = [check(spark, KEYS, rows, prefilter=None, shared_codebook=shared).get_stats()["bucket_stats"]["total_solution_bits"] for shared in (False, True)]
    assert bits[0] < 0.8 * bits[1]
    for values, tier, config in ((rows, "compact", k.AutoFilterConfig()), (fixed, "compact", k.XORFilterConfig(6)), (fixed, "relational", k.BloomFilterConfig(8, 4))):
        index = check(spark, KEYS, values, prefilter=config, tier=tier)
        index.save(f"{tmp_path}/{tier}")
        assert k.load(spark, f"{tmp_path}/{tier}").query_batch(KEYS) == values
    constant = [[7, 8]] * 1000
    assert check(spark, KEYS, constant, prefilter=k.BloomFilterConfig(8, 4)).get_stats()["filter_stats"]["num_elements"] == 0


def test_code_of_any_number_of_symbols():
    """Against counting out every symbol; a class of 10^9 symbols costs no more than one of 10."""
    draw = np.random.default_rng(5)
    for _ in range(300):
        freqs = sorted(draw.integers(1, int(draw.integers(2, 40)), int(draw.integers(2, 60))).tolist())
        heap, total = list(freqs), 0
        while len(heap) > 1:
            heap.sort()
            heap = [heap[0] + heap[1], *heap[2:]]
            total += heap[0]
        assert sum(f * n for f, n in zip(freqs, dictionary.code_lengths(freqs), strict=True)) == total
    assert dictionary.length_counts([(1, 1 << 30), (1 << 30, 1)]) == [0, 1, *[0] * 29, 1 << 30]


def test_keys(spark):
    assert k.from_lists(spark, [b"a", "b"], [1, 2]).query(b"b") == 2
    numbers = np.arange(50, dtype=np.uint32)
    assert k.from_lists(spark, numbers, numbers * 2).query(7) == 14
    table = spark.createDataFrame([(1, 10)], "key long, value long")
    index = k.build(table, tier="relational")
    assert index.query(99) is None and index.query(1) == 10


@pytest.mark.parametrize(
    ("keys", "values", "options", "error"),
    [
        ([], [], {}, ValueError),
        (["a"], [1, 2], {}, ValueError),
        (["a"], [-1], {}, ValueError),
        (["a"], [1.5], {}, ValueError),
        (["a", "a"], [1, 2], {}, RuntimeError),
        (["a"], [[]], {}, ValueError),
        ([1], [1], {}, ValueError),
        (["a"], [1], {"strategy": "packed"}, ValueError),
        (["a"], [[1]], {"strategy": "other"}, ValueError),
        (["a"], [[1]], {"strategy": "packed", "shared_codebook": True}, ValueError),
        (["a", "b"], [["lol"], ["loll"]], {"permutation": k.GlobalSortPermutationConfig()}, ValueError),
        (["a", "b"], [[1], [1, 2]], {"shared_filter": True}, ValueError),
        (["a"], [2**64], {}, ValueError),
    ],
)
def test_errors(spark, keys, values, options, error):
    with pytest.raises(error):
        k.from_lists(spark, keys, values, **options)


def test_config_errors(spark, tmp_path):
    for bad in (lambda: k.BloomFilterConfig(0, 1), lambda: k.XORFilterConfig(33), lambda: k.BinaryFuseFilterConfig(0)):
        with pytest.raises(ValueError, match="must be"):
            bad()
    few = spark.createDataFrame([(f"k{i}",) for i in range(5)], "key string")
    with pytest.raises(ValueError, match="at least"):
        filters.make_filter(few, k.BinaryFuseFilterConfig(8))
    assert filters.make_filter(few.limit(0), k.BinaryFuseFilterConfig(8)).survivors(few).count() == 0
    k.from_lists(spark, ["a", "b"], [1, 2]).save(f"{tmp_path}/x")
    with pytest.raises(storage.DeserializationError):
        k.load(spark, f"{tmp_path}/x", "fixed-uint32")


def test_membership_rates(spark):
    own = spark.range(3000).selectExpr("concat('in', id) key")
    other = spark.range(3000).selectExpr("concat('out', id) key")
    for config, rate in ((k.BloomFilterConfig(10, 7), 0.01), (k.XORFilterConfig(8), 2**-8), (k.BinaryFuseFilterConfig(8), 2**-8)):
        made = filters.make_filter(own, config)
        assert made.survivors(own).count() == 3000 and made.survivors(other).count() < 3 * rate * 3000 + 10
    sharded = filters.ShardedFilter.of(own, k.XORFilterConfig(8), shard_keys=500)
    assert sharded.count == 6 and sharded.survivors(own).count() == 3000
    wide = filters.BloomFilter.fixed(own, 30_000, 7)
    literal, filters.LITERAL_BITS = filters.LITERAL_BITS, 0
    try:
        assert wide.survivors(own).count() == 3000 and wide.survivors(other).count() < 100
    finally:
        filters.LITERAL_BITS = literal
    assert [sizes.best_hashes(m, 1000) for m in (1450, 7200)] == [1, 5] and sizes.fingerprint_bits(0.01) == 7 and sizes.fingerprint_bits(2) == 8


def test_auto_choice(spark):
    stats = lambda values: dictionary.dominance(dictionary.histogram(spark.createDataFrame([(v,) for v in values], "value long")))
    assert autofilter.chosen(stats([42] * 900 + list(range(100)))) is not None
    assert autofilter.chosen(stats(range(1000))) is None and autofilter.chosen(stats([7] * 1000)) is None and autofilter.chosen(stats([7] * 990 + list(range(10)))) is None
    row = spark.range(1).select(autofilter.lower_bound(*map(autofilter.F.lit, (0.9, 0.5, 1.23, 0.1))).alias("x")).first()
    assert math.isclose(row["x"], 0.26705)


def test_bits_per_key(spark):
    """The compact tier's bits stay near the entropy."""
    draw = np.random.default_rng(1)
    values = draw.choice([0, 1, 2, 3], 20_000, p=[0.5, 0.25, 0.125, 0.125]).tolist()
    index = k.from_lists(spark, [f"k{i}" for i in range(20_000)], values, prefilter=None)
    assert index.get_stats()["bucket_stats"]["total_solution_bits"] / 20_000 < 1.75 * 1.15


def test_solver():
    draw = np.random.default_rng(2)
    for n, m in ((1, 3), (50, 60), (400, 450)):
        rows = [draw.choice(m, 3, replace=False).tolist() for _ in range(n)]
        values = draw.integers(0, 2, n).tolist()
        if (found := compact.solve(rows, values, m)) is not None:
            assert [sum(found[v] for v in r) % 2 for r in rows] == values
    assert compact.solve([[0, 1], [0, 1]], [0, 1], 4) is None and compact.solve([[0, 1], [0, 1]], [1, 1], 4) is not None


def test_solver_finds_all_solvable():
    """Against plain elimination of every equation: contradictions are found, and nothing else."""
    draw = np.random.default_rng(3)
    outcomes = set()
    for _ in range(300):
        n, m = int(draw.integers(1, 14)), int(draw.integers(3, 10))
        rows, values = [draw.choice(m, int(draw.integers(1, 4)), replace=False).tolist() for _ in range(n)], draw.integers(0, 2, n).tolist()
        solvable = any(all(sum(x >> v & 1 for v in r) % 2 == y for r, y in zip(rows, values, strict=True)) for x in range(1 << m))
        found = compact.solve(rows, values, m)
        assert (found is not None) == solvable
        assert found is None or [sum(found[v] for v in r) % 2 for r in rows] == values
        outcomes.add(solvable)
    assert outcomes == {True, False}


def entropy_of(matrix):
    total = 0.0
    for column in zip(*matrix, strict=True):
        total += dictionary.bits_for([column.count(v) for v in set(column)])
    return total


def test_permutations(spark):
    rows = [list(map(int, np.random.default_rng(i).permutation(8))) for i in range(200)]
    df = spark.createDataFrame([(f"r{i}", r) for i, r in enumerate(rows)], "key string, values array<bigint>")
    for config in (k.GlobalSortPermutationConfig(0), k.GlobalSortPermutationConfig(3), k.EntropyPermutationConfig()):
        got = [r["values"] for r in k.permuted(df, config).collect()]
        assert all(sorted(r) == list(range(8)) for r in got) and entropy_of(got) <= 1e-9 + entropy_of(rows)
    got = permute.entropy_greedy([[0, 1, 2, 3, 4, 5, 6, 0], [1, 0, 0, 1, 0, 1, 2, 2]])
    assert [sorted(r) for r in got] == [[0, 0, 1, 2, 3, 4, 5, 6], [0, 0, 0, 1, 1, 1, 2, 2]]
    assert permute.entropy_greedy([[1, 2, 9], [2, 1]]) == [[1, 2, 9], [1, 2]]


def test_layouts(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", []), ("c", [2])], "key string, values array<bigint>")
    assert {r["key"]: r["values"] for r in arrays.padded(df).collect()} == {"a": [1, 2, 3], "b": [0, 0, 0], "c": [2, 0, 0]}
    book = dictionary.codebook(arrays.packed_histogram(df))
    packed = arrays.packed_rows(df, book)
    assert {r["key"]: r["values"] for r in arrays.unpacked_rows(packed, book).collect()} == {"a": [1, 2, 3], "b": [], "c": [2]}
    words = spark.createDataFrame([(0, 0, 0, 65), (0, 0, 1, 64), (0, 1, 0, 1)], "group int, bucket int, pos int, bits bigint")
    assert [r["offset"] for r in arrays.arena_offsets(words).orderBy("bucket", "pos").collect()] == [0, 2, 3]
    assert inference.infer(df, "values").layout == "ragged"


def test_generators(spark, tmp_path):
    for kind in ("uniform", "zipf"):
        rows = generators.distinct_rows(spark, 50, 5, 20, kind, shortest=2).collect()
        assert all(2 <= len(r["values"]) <= 5 and len(set(r["values"])) == len(r["values"]) for r in rows)
        assert rows == generators.distinct_rows(spark, 50, 5, 20, kind, shortest=2).collect()
    assert generators.distinct_rows(spark, 5, 3, 6, "tiers", tiers=[(5.0, 2), (1.0, 4)]).count() == 5
    (tmp_path / "t.csv").write_text("metric,count\n5,2\n1,4\n9,3\n")
    assert [r["start"] for r in generators.csv_tiers(spark, str(tmp_path / "t.csv")).collect()] == [0, 3, 5]
    share = generators.alpha_mix(spark, 5000, 0.9, "zipf").where(f"value = {generators.MAJORITY}").count() / 5000
    assert 0.87 < share < 0.93


def test_loaded_index_over_several_partitions(spark, tmp_path):
    """A loaded compact index answers for every bucket where the buckets are dealt to several tasks, also one whose buckets were folders."""
    rows = [(i, i * 7919 % 16) for i in range(4000)]
    df = spark.createDataFrame(rows, "key bigint, value bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = k.build(df)
        assert index.part.buckets > 4
        index.save(f"{tmp_path}/own")
        back = k.load(spark, f"{tmp_path}/own")
        assert sorted(map(tuple, back.lookup(df.select("key")).collect())) == rows
        back.part.table.write.partitionBy("bucket").parquet(f"{tmp_path}/folders")
        back.part.table = spark.read.parquet(f"{tmp_path}/folders")
        assert sorted(map(tuple, back.lookup(df.select("key")).collect())) == rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_round(rows):
    """A refinement round on lists: pairs of cell and column, best first, and what is left where there is room."""
    counts = {}
    for row in rows:
        for p, v in enumerate(row):
            counts[v, p] = counts.get((v, p), 0) + 1
    out = []
    for row in rows:
        slots, done = {}, set()
        for _, _, p, i in sorted((-counts[v, p], v, p, i) for i, v in enumerate(row) for p in range(len(row)) if (v, p) in counts):
            if p not in slots and i not in done:
                slots[p] = row[i]
                done.add(i)
        rest = iter(v for i, v in enumerate(row) if i not in done)
        out.append([slots[p] if p in slots else next(rest) for p in range(len(row))])
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_refine_round(spark, kind):
    """Rows are refined where they are while the scores can be sent to all tasks; joined scores give the same."""
    draw = np.random.default_rng(5)
    rows = [[int(draw.integers(30)) if draw.random() < 0.5 else 1 for _ in range(draw.choice([0, 1, 3, 4, 16, 17, 20]))] for _ in range(200)]
    rows = [[v if kind == "bigint" else f"é{v}" for v in row] for row in rows]
    df = spark.createDataFrame(list(enumerate(rows)), f"key int, values array<{kind}>")
    near, joined = permute.refine_round(df), permute.refine_round(df, most=3)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    for got in (near, joined):
        assert [r["values"] for r in got.orderBy("key").collect()] == plain_round(rows)
