"""The ways taken when a side is large or a group is hot give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from capledger.operators import bounded, effective, membership, ordered, quantile, stabbing
from capledger.operators.ordered import ordered_scan
from capledger.operators.rollup import fingerprint


@pytest.fixture
def nothing_fits(monkeypatch):
    monkeypatch.setattr(bounded, "fits", lambda *a, **k: False)
    monkeypatch.setattr(bounded, "few_rows", lambda *a, **k: None)
    monkeypatch.setattr(bounded, "localized", lambda *a, **k: None)
    monkeypatch.setattr(effective, "localized", lambda *a, **k: None)


def brute_scan(rows):
    """Per key and in order: running total, last value so far, before, previous, next."""
    out = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        total, last = 0, None
        for i, (k, o, v) in enumerate(group):
            before = last
            total, last = total + (v or 0), v if v is not None else last
            out.append((k, o, v, total, last, before, group[i - 1][2] if i else None,
                        group[i + 1][2] if i + 1 < len(group) else None, i + 1 == len(group)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 3, 50, 10_000])
def test_scan_over_blocks_equals_a_plain_walk(spark, span):
    rng = random.Random(span)
    places = rng.sample(range(5_000), 400)
    rows = [("hot" if i % 3 else f"k{rng.randrange(5)}", o, rng.choice([None, 1, 2, 5])) for i, o in enumerate(places)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    out = ordered_scan(
        df, ["k"], ["o"], F.floor(F.col("o") / span), totals={"total": F.col("v")}, last={"last": F.col("v")},
        last_before={"before": F.col("v")}, previous={"prev": F.col("v")}, following={"next": F.col("v"), "more": F.lit(1)},
    ).select("k", "o", "v", "total", "last", "before", "prev", "next", F.col("more").isNull())
    assert sorted(map(tuple, out.collect()), key=str) == brute_scan(rows)


def test_salted_and_broadcast_joins_agree(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, n int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(str, bounded.salted_join(big, small, ["k"], how).collect()))
        assert a == sorted(map(str, big.join(small, "k", how).collect()))
    with pytest.raises(ValueError):
        bounded.salted_join(big, small, ["k"], "right")


def test_hot_keys_are_kept_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(bounded, "HOT_ROWS", 50)
    keys = [7] * 200 + [None] * 100 + list(range(100))
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, n int")
    small = spark.createDataFrame([(7, 1), (7, 2), (3, 3), (None, 4), (500, 5)], "k long, v int")
    assert len(bounded.hot_keys(big, ["k"])) == 2
    for how in ("left", "inner", "left_semi", "left_anti"):
        for few in (True, False):  # the hot rows of the other side fit, or do not
            with monkeypatch.context() as m:
                m.setattr(bounded, "fits", lambda df, few=few: few)
                got = bounded.split_join(big, small, ["k"], how)
                assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    assert bounded.hot_keys(big.where("n > 300"), ["k"]) == []
    assert bounded.hot_keys(big.where("false"), ["k"]) == []


def test_salt_spreads_one_key_and_reads_nested_columns(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), "id").alias("m"), F.array("id").alias("a"))
    used = df.select(bounded._salt_of(df, 16).alias("s")).groupBy("s").count()
    assert used.count() == 16


def test_fits_measures_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert bounded.fits(df) and not bounded.fits(df, max_rows=99) and not bounded.fits(df, max_bytes=50_000)
    assert bounded.fits(df.limit(0)) and bounded.few_rows(df, 99) is None and len(bounded.few_rows(df, 100)) == 100


def test_cross_rows_with_and_without_a_literal(spark, nothing_fits):
    df, rows = spark.range(50), spark.createDataFrame([(1, 2), (3, None)], "a int, b int")
    assert bounded.cross_rows(df, rows).count() == 100


def test_cross_rows_of_no_rows(spark):
    out = bounded.cross_rows(spark.range(5), spark.createDataFrame([], "a int"))
    assert out.columns == ["id", "a"] and out.count() == 0


def pick(rates, s, e):
    inside = [r for r in rates if r[0] is not None and r[1] is not None and r[0] <= s and r[1] >= e]
    if inside:
        return max(inside, key=lambda r: (r[0], -r[1], r[2]))[2]
    always = [r for r in rates if r[0] is None]
    if always:
        return max(always, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2]))[2]
    ended = [r for r in rates if r[0] is not None and r[1] is not None and r[1] < s]
    return max(ended, key=lambda r: (r[1], r[0], r[2]))[2] if ended else None


def random_rates(seed):
    rng = random.Random(seed)
    out = []
    for key in range(40):
        for _ in range(rng.randrange(5)):
            s = rng.choice([None, 2020, 2024, 2028, 2030, 2033])
            e = None if rng.random() < 0.2 else (s or 2020) + rng.randrange(12)
            out.append((f"k{key}", s, e, rng.randrange(100)))
    return out


PERIODS = [(2024, 2029), (2030, 2034), (2035, 2039), (2040, 2049)]


def check_effective(spark, seed):
    rows = random_rates(seed)
    rates = spark.createDataFrame(rows, "key string, period_start int, period_end int, value int")
    periods = spark.createDataFrame(PERIODS, "period_start int, period_end int")
    got = {tuple(r)[:3]: r[3] for r in effective.effective_rate(rates, periods, "key", "value").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for s, e in PERIODS:
            v = pick([r[1:] for r in rows if r[0] == k], s, e)
            if v is not None:
                want[k, s, e] = v
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_effective_rate_equals_the_stated_preference(spark, seed):
    check_effective(spark, seed)


def test_effective_rate_over_many_periods(spark, nothing_fits):
    check_effective(spark, 9)


def check_many(spark, rows, spans, key="string"):
    rates = spark.createDataFrame(rows, f"key {key}, period_start int, period_end int, value int")
    periods = spark.createDataFrame(spans, "period_start int, period_end int")
    got = {tuple(r)[:3]: r[3] for r in stabbing.effective_rate_many(rates, periods, "key", "value").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for s, e in set(spans):
            v = pick([r[1:] for r in rows if r[0] == k], s, e)
            if v is not None:
                want[k, s, e] = v
    assert got == want


@pytest.mark.parametrize("bits,seed", [(1, 1), (2, 2), (6, 3), (6, 4)])
def test_rates_found_in_the_tree_equal_the_stated_preference(spark, monkeypatch, bits, seed):
    monkeypatch.setattr(stabbing, "BITS", bits)
    monkeypatch.setattr(stabbing, "SCAN_BITS", bits)
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        s = rng.choice([None, *range(-120, 300)]) if seed % 2 else rng.randrange(-120, 300)
        e = None if rng.random() < 0.1 else (s or 0) + rng.choice([0, 1, 5, 40, 300])
        rows.append((rng.choice(["hot", "hot", "k1", "k2", None]), s, e, rng.randrange(50)))
    spans = [(s, s + rng.choice([-3, 0, 2, 30])) for s in rng.choices(range(-150, 400), k=90)]
    check_many(spark, rows + rows[:9], spans + spans[:5])


def test_tree_of_rates_without_literals_or_broadcasts(spark, nothing_fits):
    check_many(spark, random_rates(5), PERIODS)


def test_tree_of_no_rates_and_no_periods(spark):
    check_many(spark, [], PERIODS)
    check_many(spark, random_rates(1), [])
    check_many(spark, [("a", None, None, 3), ("b", 2020, None, 4)], PERIODS)


def test_many_periods_take_the_tree(spark):
    rates = spark.range(1000).selectExpr("'k' AS key", "CAST(id AS INT) AS period_start", "CAST(id + 3 AS INT) AS period_end", "id AS value")
    periods = spark.range(200).selectExpr("CAST(id * 5 AS INT) AS period_start", "CAST(id * 5 + 2 AS INT) AS period_end")
    got = effective.effective_rate(rates, periods, "key", "value")
    assert sorted((r.period_start, r.value) for r in got.collect()) == [(i * 5, i * 5) for i in range(200)]
    assert got.schema["period_end"].dataType.simpleString() == "int"


def test_membership_when_the_list_is_long(spark, nothing_fits):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    out = membership.flag_membership(df, spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k")
    assert sorted(map(str, out.collect())) == sorted(
        ["Row(k='a', is_listed=True)"] * 2 + ["Row(k='b', is_listed=False)", "Row(k=None, is_listed=False)"])


@pytest.mark.parametrize("small", [0, 10, 100_000])
def test_median_of_hot_and_small_groups(spark, monkeypatch, small):
    monkeypatch.setattr(quantile, "SMALL_GROUP", small)
    rng = random.Random(small)
    values = {"hot": [rng.choice([1.5, 2.5, rng.gauss(0, 100)]) for _ in range(3001)], "two": [1.0, 4.0], "one": [7.0],
              "same": [3.0] * 10, "even": [float(i) for i in range(1000)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("none", None)], "k string, v double")
    got = {r["k"]: r["median"] for r in quantile.exact_median(df, ["k"], "v").collect()}

    def median(vs):
        vs = sorted(vs)
        return (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2

    assert got == {k: median(vs) for k, vs in values.items()}
    whole = quantile.exact_median(df, [], "v").first()[0]
    assert whole == median([v for vs in values.values() for v in vs])


def test_the_middle_of_a_large_group_is_cut_until_one_task_may_sort_it(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL_GROUP", 40)
    monkeypatch.setattr(quantile, "BLOCKS", 32)
    rounds = []
    cut = quantile._placed

    def counted(counts, keys, single):
        rounds.append(max(r[0] for r in counts.groupBy(*keys).agg(F.count(F.lit(1))).select("count(1)").collect()))
        return cut(counts, keys, single)

    monkeypatch.setattr(quantile, "_placed", counted)
    # All values of a group differ; both middle values of "even" stand at the border of many blocks.
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "odd").otherwise("even").alias("k"), (F.hash("id").cast("double") / 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([("odd", 1e300)], "k string, v double"))
    got = {r["k"]: r["median"] for r in quantile.exact_median(df, ["k"], "v").collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    assert len(rounds) >= 2 and rounds[0] > 30_000 and all(later < before / 8 for before, later in zip(rounds, rounds[1:]))


def test_fingerprint_is_of_the_set(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "h string")
    mark = fingerprint(df, "h")
    assert len(mark) == 64 and mark == fingerprint(df.distinct(), "h") == fingerprint(df.repartition(5), "h")
    assert mark != fingerprint(df.where("h = 'a'").union(spark.createDataFrame([("c",)], "h string")), "h")
    many = spark.range(20_000).selectExpr("sha2(string(id), 256) AS h")
    assert len(fingerprint(many, "h")) == 64 and fingerprint(many, "h") != fingerprint(many.limit(19_999), "h")
    assert fingerprint(df.where("h IS NULL"), "h") == fingerprint(df.limit(0), "h")


def test_null_keys_meet(spark):
    from capledger.operators.membership import flag_any_member
    from capledger.operators.rollup import fact_conflicts, profile

    facts = spark.createDataFrame([("Gas", None, 1), ("Gas", None, 2), ("Oil", 2024, 3)], "fuel string, start int, value int")
    assert sorted(r["value"] for r in fact_conflicts(facts, ["fuel", "start"], "value").collect()) == [1, 2]
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "c string, x double")
    assert {r["c"]: r["median"] for r in profile(rows, "c", "x").collect()} == {None: 2.0, "a": 5.0}
    listed = spark.createDataFrame([("k",), (None,)], "key string")
    df = spark.createDataFrame([(None, ["k"]), (1, ["z"]), (1, ["k", None]), (2, None)], "id int, keys array<string>")
    got = flag_any_member(df, listed, "keys", "key").collect()
    assert [r["is_listed"] for r in got] == [True, False, True, False]


def test_many_first_rows_are_picked_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id AS v").repartition(4)
    got = ordered.first_per_key(df, ["k"], [F.col("v").desc()], 1500)
    assert got.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")).orderBy("k").collect() == [(0, 1500, 2000), (1, 1500, 2001)]


def test_scratch_is_in_a_shared_folder(spark):
    from capledger.sources.scratch import scratch_root, stored

    held = stored(spark.range(3), "x")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert scratch_root(spark).startswith(shared) and held.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(scratch_root(spark).split(":", 1)[-1].lstrip("/"))
    assert scratch_root(spark.newSession()) == scratch_root(spark)


def test_small_groups_take_one_shuffle_and_large_ones_blocks(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i % 5 or None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long")

    def scan(df):
        return ordered_scan(
            df, ["k"], ["o"], F.floor(F.col("o") / 20), totals={"total": F.col("v")}, last={"last": F.col("v")},
            last_before={"before": F.col("v")}, previous={"prev": F.col("v")}, following={"next": F.col("v"), "more": F.lit(1)},
        )

    def seen(out):
        return sorted(map(tuple, out.select("k", "o", "v", "total", "last", "before", "prev", "next", F.col("more").isNull()).collect()), key=str)

    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert seen(scan(df)) == brute_scan(rows)
    monkeypatch.setattr(bounded, "HOT_ROWS", 50)
    assert len(bounded.hot_keys(df, ["k"])) == 1
    assert seen(scan(df)) == brute_scan(rows) and scan(df).schema["total"].dataType.simpleString() == "bigint"
    # a NULL key has nothing carried from block to block, and NULL places are cut into blocks as well
    lost = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (None, 30, 7)], "k string, o long, v long")
    assert [r["total"] for r in scan(lost).orderBy("o").collect()] == [5, 11, 7]
    assert bounded.hot_keys(df.withColumn("o", F.lit(None)), ["k"], unless=F.col("o").isNull()) is None


def test_rows_beside_the_columns_of_their_table(spark):
    from capledger.operators.layout import table_rows

    cell = "doc string, table_ref string, row int, col int, text string, column_header boolean, row_section boolean"
    cells = [("d", t, r, c, f"{r}{c}", False, False) for t in ("a", "b") for r in range(2) for c in range(3)]
    cells += [("d", "a", 2, 0, "x", False, False), ("d", "a", 2, 2, "y", False, False), ("d", "a", 3, 5, "z", False, False), ("d", "b", 2, 1, "", False, False)]
    tables = spark.createDataFrame([("d", "a", ["A", "", "A"], False, False), ("d", "b", ["B", "", "C"], True, False)],
                                   "doc string, table_ref string, headers array<string>, skip_first_row boolean, is_continuation boolean")
    got = {(r["table_ref"], r["row"]): r["cells"] for r in table_rows(spark.createDataFrame(cells, cell), tables).collect()}
    assert got == {
        ("a", 0): {"col_1": "01", "A": "02"}, ("a", 1): {"col_1": "11", "A": "12"}, ("a", 2): {"A": "y"}, ("a", 3): {"col_5": "z"},
        ("b", 1): {"B": "10", "col_1": "11", "C": "12"},
    }
