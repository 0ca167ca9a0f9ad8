import numpy as np
from pyspark.sql import functions as F

from seqlattice.operators import align, estimate, msa
from seqlattice.operators.distance import pair_statistics
from seqlattice.operators.pairs import all_pairs
from seqlattice.operators.scoring import AlignConfig, Scoring, collected, normalised, step_costs
from seqlattice.sources import matrix

SCORES = 6 * np.eye(23) - 2


def _collections(spark, n=3, seed=1):
    rng = np.random.default_rng(seed)
    letters = np.array(list("ARNDCQEGHILKMFPSTWYV"))
    rows = []
    for a in range(n):
        base = rng.choice(letters, 40)
        for k in range(a + 1):
            kept = rng.random(40) > 0.1
            x = np.where(rng.random(40) < 0.1, rng.choice(letters, 40), base)[kept]
            rows.append((f"c{a}", k * 3, "".join(x)))
    rows += [("none", 0, ""), ("none", 1, "ACD"), ("nulls", 0, None), (None, 0, "ACD")]
    return spark.createDataFrame(rows, "aln_id string, seq_idx int, seq string")


def test_multiple_alignment_keeps_the_sequences(spark):
    sequences = _collections(spark, 5)
    got = msa.multiple_alignment(sequences, all_pairs(sequences, "seq"), Scoring(SCORES, None, AlignConfig(refinements=3))).toPandas()
    want = {(r.aln_id, r.seq_idx): r.seq for r in sequences.collect() if r.aln_id and r.seq is not None}
    assert {(r.aln_id, r.seq_idx): r.row.replace("-", "") for r in got.itertuples()} == want
    assert (got.groupby("aln_id").row.apply(lambda x: x.str.len().nunique()) == 1).all()
    assert not got.duplicated(["aln_id", "seq_idx"]).any()


def test_large_alignments_go_by_joins(spark, monkeypatch):
    sequences = _collections(spark, 4)
    pairs, scoring = all_pairs(sequences, "seq"), Scoring(SCORES, None, AlignConfig(refinements=2))
    small = msa.multiple_alignment(sequences, pairs, scoring).toPandas()
    monkeypatch.setattr(msa, "_TOGETHER", 0)
    large = msa.multiple_alignment(sequences, pairs, scoring).toPandas()
    key = ["aln_id", "seq_idx"]
    assert small.sort_values(key).row.tolist() == large.sort_values(key).row.tolist()


def test_equal_sequences_align_without_gaps(spark):
    rows = spark.createDataFrame([("a", k, "MKVLAAGIWY") for k in range(4)], "aln_id string, seq_idx int, seq string")
    got = msa.multiple_alignment(rows, all_pairs(rows, "seq"), Scoring(SCORES, None, AlignConfig())).toPandas()
    assert got.row.tolist() == ["MKVLAAGIWY"] * 4


def test_paths_profiles_and_blend(spark):
    pairs = spark.createDataFrame([("a", 0, 1, "ACDEF", "ACEF"), ("a", 0, 2, "ACD", None), ("b", 0, 1, "", "AC")], "aln_id string, i int, j int, seq_i string, seq_j string")
    scoring = Scoring(SCORES, None, AlignConfig())
    paths = align.path_alignments(pairs, scoring)
    got = {(r.aln_id, r.i, r.j): r.script for r in paths.collect()}
    assert set(got) == {("a", 0, 1), ("b", 0, 1)} and got["b", 0, 1] == "YY"
    cells = {(r.r, r.c) for r in align.path_profile(paths).filter("aln_id = 'a'").collect()}
    assert cells == {(1, 1), (2, 2), (4, 3), (5, 4)}
    post = align.posterior_profile(pairs, scoring)
    blend = align.blended(align.path_profile(paths), post)
    assert {(r.r, r.c) for r in blend.collect()} >= cells
    assert blend.agg(F.max("p")).first()[0] <= 1 + 1e-9
    rows = align.gapped_rows(paths.join(pairs, ["aln_id", "i", "j"])).filter("aln_id = 'a'").first()
    assert (rows.row_i, rows.row_j) == ("ACDEF", "AC-EF")
    assert align.path_alignments(pairs.limit(0), scoring).count() == 0


def test_library(spark):
    pairs = spark.createDataFrame([("a", 0, 1, "ACDEF", "ACEF")], "aln_id string, i int, j int, seq_i string, seq_j string")
    sequences = spark.createDataFrame([("a", 0, "one", "ACDEF"), ("a", 1, None, "ACEF")], "aln_id string, seq_idx int, name string, seq string")
    paths = align.path_alignments(pairs, Scoring(SCORES, None, AlignConfig()))
    lines = align.library_lines(sequences, paths, paths.select("aln_id", "i", "j", F.lit(0.8).alias("distance")))
    text = [r.line for r in lines.orderBy("block", "line_no").collect()]
    assert text == ["! TC_LIB_FORMAT_01", "2", "one 5 ACDEF", " 4 ACEF", "#1 2", "    1     1   800", "    2     2   800", "    4     3   800", "    5     4   800", "! SEQ_1_TO_N"]


def test_seeds_find_every_pair_with_enough_in_common(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACDE"), 60)) for _ in range(30)] + ["", "ACD"]
    records = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id bigint, seq string")
    got = {(r.query, r.subject) for r in align.seeded_pairs(records.filter("id % 5 = 0"), records, 5, 2).collect()}
    grams = [{x[k : k + 5] for k in range(len(x) - 4)} for x in texts]
    assert got == {(a, b) for a in range(0, 32, 5) for b in range(32) if a != b and len(grams[a] & grams[b]) >= 2}


def test_profile_merged(spark):
    profile = spark.createDataFrame([("a", 0, 2, 1, 1, 0.5), ("a", 1, 2, 2, 1, 1.0)], "aln_id string, i int, j int, r int, c int, p double")
    first = spark.createDataFrame([("a", 1, "-AC", 1.0), ("a", 0, "D--", 3.0)], "aln_id string, seq_idx int, row string, w double")
    second = spark.createDataFrame([("a", 2, "-W", 2.0)], "aln_id string, seq_idx int, row string, w double")
    got = {(r.x, r.y): r.p for r in align.profile_merged(profile, first, second).collect()}
    assert got == {(1, 2): 3 * 2 * 0.5 / 8, (3, 2): 1 * 2 * 1.0 / 8}


def test_statistics(spark):
    pairs = spark.createDataFrame([("a", 0, 1, "AC-D", "AC-E"), ("a", 0, 2, "---", "---"), ("a", 0, 3, "", "AC"), ("a", 0, 4, None, "A")], "aln_id string, i int, j int, row_i string, row_j string")
    got = {r.j: r for r in pair_statistics(pairs).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].gid == 0.75 and abs(got[1].lid - 2 / 3) < 1e-12 and abs(got[1].pdist - 1 / 3) < 1e-12
    assert got[2].gid == 1 and got[2].lid == 0 and got[2].eer == 0 and got[3].gid == 0
    marked = pair_statistics(pairs.filter("j = 1"), sentinel=True).first()
    assert marked.gid == 0.8 and marked.lid == 0.75


def test_counts_and_quantities(spark):
    pairs = spark.createDataFrame([("AR-N", "AR-D", 1.0), ("A", None, 1.0), ("CC", "WW", 1.0)], "row_i string, row_j string, w double")
    n = {(r.a, r.b): r.n for r in estimate.pair_counts(pairs).collect()}
    assert n == {(0, 0): 1, (1, 1): 1, (2, 3): 1}  # the pair without an equal residue is left out
    steps = {(r.a1, r.b1, r.a2, r.b2): r.n for r in estimate.transition_counts(pairs).collect()}
    assert steps == {(0, 0, 1, 1): 1, (1, 1, 2, 3): 1}
    certain = estimate.transition_quantity(estimate.transition_probabilities(estimate.transition_counts(pairs)))
    assert [r.q for r in certain.collect()] == [0.0, 0.0]
    assert estimate.transition_counts(pairs.limit(0)).count() == 0


def test_step_costs_by_hand(spark):
    scores = spark.createDataFrame([(a, b, 15.0 if a == b == 17 else 4.0 if a == b == 0 else -6.0) for a in range(23) for b in range(23)], "a int, b int, score double")
    got = {(r.a1, r.b1, r.a2, r.b2): int(r.cost * 1000) for r in step_costs(scores, None, AlignConfig()).filter("a1 in (0, 23) and b1 in (0, 23, 24)").collect()}
    assert got[0, 0, 0, 23] == 278 and got[0, 23, 0, 23] == 163 and got[0, 0, 17, 17] == 0 and got[0, 0, 0, 0] == 117
    assert {r.d for r in normalised(scores, AlignConfig(mode=2)).collect()} == {-15.0, -4.0, 6.0}
    assert collected(scores, None, AlignConfig()).scores[0, 0] == 4


def test_matrix_formats(spark, tmp_path):
    square = tmp_path / "square"
    square.write_text("# comment\n   A  R  *\nA  4 -1  0\nR -2  5  0\n* 0 0 1\n")
    got = {(r.a, r.b): r.score for r in matrix.read_matrix(spark, str(square)).collect()}
    assert got == {(0, 0): 4.0, (0, 1): -2.0, (1, 0): -2.0, (1, 1): 5.0}
    triangle = tmp_path / "triangle"
    triangle.write_text("#This matrix\nA 0\nR 1.5 0\n")
    assert {(r.a, r.b): r.score for r in matrix.read_matrix(spark, str(triangle)).collect()} == {(0, 0): 0, (0, 1): 1.5, (1, 0): 1.5, (1, 1): 0}
    listed = tmp_path / "listed"
    listed.write_text("#WEIGHTED MATRIX#\n3,square\n1,triangle\n")
    assert {(r.a, r.b): r.score for r in matrix.read_matrix(spark, str(listed)).collect()}[0, 0] == 3.0
    assert {(r.a, r.b): r.score for r in matrix.read_matrix(spark, str(listed), last_wins=True).collect()}[0, 1] == 1.5
    back = matrix.parse_square(matrix.square_text(matrix.read_matrix(spark, str(square)), 0)).filter("a < 2 and b < 2")
    assert {(r.a, r.b): r.score for r in back.collect()} == got
    assert matrix.identity(spark).agg(F.sum("score")).first()[0] == 23
    full = {(r.a, r.b): r.score for r in matrix.average_ambiguous(matrix.identity(spark)).collect()}
    assert full[20, 3] == 0.5 and full[20, 20] == 0.5


def test_transition_table_round_trip(spark):
    table = spark.createDataFrame([(0, 0, 1, 1, 0.25, 0.5, 3.0), (22, 23, 23, 22, 1.0, 0.0, 0.0)], "a1 int, b1 int, a2 int, b2 int, q double, p double, n double")
    lines = matrix.transitions_text(table, 3)
    assert lines.orderBy("no").first().line == "format_ITO=3"
    assert sorted(map(tuple, matrix.parse_transitions(lines).collect())) == sorted(map(tuple, table.collect()))
    older = spark.createDataFrame([(0, "AA RR 0.25")], "no int, line string")
    assert matrix.parse_transitions(older).first().q == 0.25


def test_path_as_a_column_function(spark):
    from seqlattice.functions.udfs import path_udf

    rows = spark.createDataFrame([("ACDEF", "ACEF"), (None, "A"), ("", "AC")], "a string, b string")
    got = [r.x for r in rows.select(path_udf(Scoring(SCORES, None, AlignConfig()))("a", "b").alias("x")).collect()]
    assert got[0].script == "BBXBB" and got[1].script is None and got[2].script == "YY"


def test_profile_merge_weighted_is_exact(spark, tmp_path):
    """Each value is the exact mean, of halves rounded up: sums of hundredths would hang on their order."""
    from collections import defaultdict
    from fractions import Fraction

    from seqlattice.operators.pairs import alignment_rows
    from seqlattice.plans import alignment

    spark.read.parquet("/root/testdata/sf0.01/sequences.parquet").filter("aln_id in ('BB110000155', 'BB300000196')").write.parquet(f"{tmp_path}/sequences.parquet")
    members = defaultdict(list)
    for r in alignment_rows(spark, str(tmp_path)).orderBy("aln_id", "seq_idx").collect():
        members[r.aln_id].append(r.row)
    want = {}
    for aln_id, (first, *others) in members.items():
        sizes = [len(x.replace("-", "")) for x in others]
        for k, letter in enumerate(first):
            met = [(n, x[k]) for n, x in zip(sizes, others, strict=True) if x[k : k + 1] not in ("", "-")]
            if letter != "-" and met:
                p = Fraction(sum(n * (2 if x == letter else 1) for n, x in met), 2 * sum(sizes))
                want[aln_id, k + 1 - first[:k].count("-"), k + 1] = int(p * 10**6 + Fraction(1, 2)) / 1e6
    got = {(r.aln_id, r.x, r.y): r.p for r in alignment.profile_merge_weighted(spark, str(tmp_path)).collect()}
    assert got == want


def test_first_merged(spark):
    """The same as the matches of all pairs merged by joins, also of rows of unlike lengths; and no match is made a row before."""
    from seqlattice.functions import residues as R

    rng = np.random.default_rng(5)
    rows = [(f"a{a}", 3 * k + 2, "".join(rng.choice(list("AC-"), 30 - int(rng.integers(4)))), float(k % 4)) for a in range(6) for k in range(a + 1)]
    rows = spark.createDataFrame([*rows, ("b", 0, "A-C", 2.0), ("b", 1, "---", 3.0), (None, 0, "AC", 1.0), (None, 1, "AC", 1.0)], "aln_id string, seq_idx int, row string, w double").repartition(3)
    first = rows.groupBy("aln_id").agg(F.min(F.struct("seq_idx", "row", "w")).alias("_f")).select("aln_id", "_f.*").withColumn("w", F.lit(1.0))
    others = rows.join(first.select("aln_id", "seq_idx"), ["aln_id", "seq_idx"], "left_anti")
    matches = align.aligned_matches(all_pairs(rows, "row")).withColumn("p", F.when(F.col("same"), 1.0).otherwise(0.5)).drop("same")
    for by_residue in (False, True):
        one = first.withColumn("row", R.residues(F.col("row"))) if by_residue else first
        want = {(r.aln_id, r.x, r.y): r.p for r in align.profile_merged(matches, one, others).collect() if r.p is not None}
        done = align.first_merged(rows, 0.5, by_residue)
        got = {(r.aln_id, r.x, r.y): r.p for r in done.collect()}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_merged_profiles_shuffle_rows_alone(spark):
    from seqlattice.plans import alignment

    for query in (alignment.profile_merge_sum, alignment.profile_merge_weighted):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
