import collections
import re
import unicodedata

from pyspark.sql import functions as F

from seqlattice.llm import splits, terms


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 140)]
    edges = [*chain, *star, (139, 200), (7, 7), (300, 301), (301, 300), (300, 301)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "u bigint, v bigint")
    assert dict(map(tuple, splits.components(df).collect())) == _components([e for e in edges if e[0] != e[1]])
    assert splits.components(df.limit(0)).count() == 0


def test_tied(spark):
    rows = [(5, 1), (3, 1), (9, 2), (5, 2), (4, 7), (8, 8), (8, 9), (5, 1)]
    got = set(map(tuple, splits.tied(spark.createDataFrame(rows, "g bigint, e bigint"), "g", "e").collect()))
    assert got == {(3, 3), (5, 3), (9, 3)}


def test_numbers(spark):
    cases = {"#12": [12], "SCOP:0012": [12], "12.0": [12], "1; 2|3 & 1": [1, 2, 3], "0": [], "n/a": [], None: [], "": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", splits.numbers(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_assign_keeps_components_whole_and_the_shares(spark):
    # one component holds a third of all rows, many are small, some have no component
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") < 60, F.lit(None)).otherwise(F.col("id") % 1500).cast("bigint").alias("c"))
    got = splits.assign(rows, "c", {"train": 0.6, "valid": 0.25, "test": 0.15})
    assert got.count() == 30_000
    assert got.groupBy("c").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    share = {r.split: r.n / 30_000 for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.6) < 0.01 and abs(share["valid"] - 0.25) < 0.01 and abs(share["test"] - 0.15) < 0.01
    assert splits.assign(rows.limit(0), "c", {"a": 1.0}).count() == 0
    assert {r.split for r in splits.assign(rows.limit(5), "c", {"a": 1.0}).collect()} == {"a"}


def test_assign_is_stable(spark):
    rows = spark.range(500).select("id", (F.col("id") % 100).alias("c"))
    one = {r.id: r.split for r in splits.assign(rows, "c", {"a": 0.5, "b": 0.5}).collect()}
    two = {r.id: r.split for r in splits.assign(rows.repartition(5), "c", {"a": 0.5, "b": 0.5}).collect()}
    assert one == two


def test_terms_by_brute_force(spark):
    names = ["A_b.c, A.", "ｄ１２．x", None, "", "...", "KK İstanbul", "a a a", "a", "A" * 100_000, "x.y..z é1", " ".join(f"t{k % 20000}" for k in range(60_000))] + ["common one"] * 50
    df = spark.createDataFrame([(k, n, 1) for k, n in enumerate(names)], "id bigint, name string, terms int")
    occurrences, records = collections.Counter(), collections.Counter()
    for name in names:
        own = [t.strip(".") for t in re.findall("[a-z0-9.]+", unicodedata.normalize("NFKC", name or "").lower())]
        own = [t for t in own if t]
        occurrences.update(own)
        records.update(set(own))
    got = {r.term: (r.occurrences, r.n_records, r.mark) for r in terms.term_frequencies(df, "name", len(names)).collect()}
    limit = 0.02 * len(names)
    assert got == {t: (occurrences[t], n, "rare" if n < 3 else "common" if n > limit else None) for t, n in records.items()}
    assert terms.term_frequencies(df.limit(0), "name", 0).count() == 0
