"""Queries that relational operators answer, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions import residues as R
from seqlattice.functions.alphabet import ALPHABET, GENETIC_CODES, code
from seqlattice.operators import curate, distance, estimate, family, scoring
from seqlattice.operators.pairs import alignment_rows, all_pairs
from seqlattice.sources import matrix
from seqlattice.sources.fasta import entries, parse
from seqlattice.sources.tables import table

ROWS = """rows_ AS (SELECT * FROM (SELECT seq_id, max(aln_id) AS aln_id, max(seq_idx) AS seq_idx, max(a_name) AS a_name, max(a_seq) AS raw,
  translate(upper(regexp_replace(max(a_seq), '[*]+$', '')), 'JOU*~.', 'XXX---') AS arow FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id) WHERE arow <> '')"""
PAIRS = ROWS + """,
pairs AS (SELECT a.aln_id, a.seq_idx AS i, b.seq_idx AS j, a.arow AS ri, b.arow AS rj, a.a_name AS ni, b.a_name AS nj
  FROM rows_ a JOIN rows_ b ON a.aln_id = b.aln_id AND a.seq_idx < b.seq_idx)"""
COLS = PAIRS + """,
cols AS (SELECT aln_id, i, j, ni, nj, c, substr(ri, c, 1) AS x, substr(rj, c, 1) AS y
  FROM (SELECT *, unnest(range(1, least(length(ri), length(rj)) + 1)) AS c FROM pairs))"""
CODED = COLS + f""",
alike AS (SELECT aln_id, i, j FROM cols GROUP BY ALL HAVING count(*) FILTER (WHERE x = y AND x <> '-') > 0),
freq AS (SELECT a_name, count(*) AS f FROM rows_ WHERE a_name IS NOT NULL GROUP BY a_name),
coded AS (SELECT cols.aln_id, cols.i, cols.j, c, instr('{ALPHABET}', x) - 1 AS a, instr('{ALPHABET}', y) - 1 AS b, coalesce(1 / sqrt(f1.f * f2.f), 1.0) AS w
  FROM cols JOIN alike ON cols.aln_id = alike.aln_id AND cols.i = alike.i AND cols.j = alike.j
  LEFT JOIN freq f1 ON f1.a_name = ni LEFT JOIN freq f2 ON f2.a_name = nj WHERE NOT (x = '-' AND y = '-'))"""
PAIR_COUNTS = CODED + """,
pc AS (SELECT a, b, count(*) AS n, sum(w) AS w FROM coded GROUP BY a, b)"""
STEPS = CODED + """,
steps AS (SELECT a AS a1, b AS b1, lead(a) OVER s AS a2, lead(b) OVER s AS b2, w FROM coded WINDOW s AS (PARTITION BY aln_id, i, j ORDER BY c)),
tc AS (SELECT a1, b1, a2, b2, count(*) AS n, sum(w) AS w FROM steps WHERE a2 IS NOT NULL GROUP BY ALL),
pure AS (SELECT * FROM tc WHERE greatest(a1, b1, a2, b2) <> 23),
sym AS (SELECT a1, b1, a2, b2, sum(w) / 2 AS w FROM (SELECT a1, b1, a2, b2, w FROM pure UNION ALL SELECT b1, a1, b2, a2, w FROM pure) GROUP BY ALL),
prob AS (SELECT *, w / sum(w) OVER (PARTITION BY a1, b1) AS p FROM sym)"""
ODDS = PAIR_COUNTS + """,
p1 AS (SELECT a, b, sum(w) / 2 AS w FROM (SELECT a, b, w FROM pc UNION ALL SELECT b, a, w FROM pc) WHERE a < 20 AND b < 20 GROUP BY a, b),
p2 AS (SELECT a, b, w / sum(w) OVER () AS p FROM p1),
p3 AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM p2),
odds AS (SELECT a, b, p, p / pa / pb AS odds, CASE WHEN p / pa / pb < 1e-9 THEN -20.0 ELSE log2(p / pa / pb) END AS score FROM p3)"""
SHARES = f"""comp AS (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(arow, '')) AS letter FROM rows_) GROUP BY letter),
shares AS (SELECT instr('{ALPHABET}', letter) - 1 AS a, n, n / sum(n) OVER () AS f FROM comp WHERE instr('{ALPHABET}', letter) - 1 BETWEEN 0 AND 19)"""
FULL = ODDS + ", " + SHARES + """,
stands AS (SELECT * FROM (VALUES (20, 2), (20, 3), (21, 5), (21, 6)) t(x, m) UNION ALL SELECT 22, unnest(range(0, 20)) UNION ALL SELECT k, k FROM (SELECT unnest(range(0, 20)) AS k)),
full_ AS (SELECT s.x AS a, t.x AS b, sum(score * f.f * g.f) / sum(f.f * g.f) AS score FROM odds
  JOIN stands s ON s.m = odds.a JOIN stands t ON t.m = odds.b JOIN shares f ON f.a = odds.a JOIN shares g ON g.a = odds.b GROUP BY s.x, t.x)"""
METRIC = FULL + """,
r AS (SELECT min(score) AS lo, max(score) AS hi FROM full_),
metric AS (SELECT a, b, score, -score / (hi - lo) + hi / (hi - lo) AS d FROM full_, r),
gaps AS (SELECT 11.0 / (hi - lo) + hi / (hi - lo) AS o, 0.3 / (hi - lo) + hi / (hi - lo) AS e FROM r)"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return alignment_rows(spark, folder)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(_rows(spark, folder), "row", "a_name")


def _statistics(*columns: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        got = distance.pair_statistics(_pairs(spark, folder))
        return got.select("aln_id", "i", "j", *(F.round(c, 6).alias(c) for c in columns))

    return query


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with w, 1/sqrt(f f'); how often a name occurs is joined to the rows, so that no pair is moved for it."""
    rows = _rows(spark, folder)
    names = rows.filter("a_name is not null").groupBy("a_name").agg(F.count(F.lit(1)).alias("f"))
    pairs = all_pairs(rows.join(names, "a_name", "left"), "row", "f")
    return pairs.withColumn("w", F.coalesce(1 / F.sqrt(F.col("f_i") * F.col("f_j")), F.lit(1.0)))


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    return estimate.transition_counts(_weighted(spark, folder))


def _quantity(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        sym = estimate.symmetric_transitions(estimate.without_gaps(_transitions(spark, folder)))
        got = estimate.transition_quantity(estimate.transition_probabilities(sym), mode)
        return got.select("a1", "b1", "a2", "b2", F.round("q", 6).alias("q"))

    return query


def tq_bzx(spark: SparkSession, folder: str) -> DataFrame:
    sym = estimate.symmetric_transitions(estimate.without_gaps(_transitions(spark, folder)))
    got = estimate.ambiguous_transitions(estimate.transition_quantity(estimate.transition_probabilities(sym)))
    return got.select("a1", "b1", "a2", "b2", F.round("q", 6).alias("q"))


def estimated_odds(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> DataFrame:
    return estimate.log_odds(estimate.pair_counts_of(counts) if counts is not None else estimate.pair_counts(_weighted(spark, folder)))


def estimated_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b, score): the 23 by 23 log-odds matrix of the alignments in ``sequences``."""
    return estimate.with_ambiguous(estimated_odds(spark, folder), estimate.residue_shares(_rows(spark, folder)))


def fasta_records(spark: SparkSession, folder: str) -> DataFrame:
    return parse(table(spark, folder, "fasta_files"), "file_id")


def fasta_entries(spark: SparkSession, folder: str) -> DataFrame:
    return entries(_rows(spark, folder).select("aln_id", "seq_idx", F.col("a_name").alias("name"), F.col("row").alias("seq")))


def validate_symbols(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("seq_id", (F.col("seq_idx") + 1).alias("sequence_no"), R.illegal_symbols(F.col("raw")).alias("symbols"))
    return rows.filter("symbols <> ''")


def encode_residues(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.transform(F.split("row", ""), lambda x: code(x).cast("string"))
    return _rows(spark, folder).select("seq_id", F.array_join(codes, " ").alias("codes"))


def residue_composition(spark: SparkSession, folder: str) -> DataFrame:
    return estimate.residue_shares(_rows(spark, folder)).select("a", "n", F.round("f", 9).alias("f"))


def degap(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("seq_id", R.residues(F.col("row")).alias("seq"))


def lower_case_mask(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("seq_id", R.without_lower_case(F.col("raw")).alias("seq"))


def position_map(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("seq_id", F.posexplode(R.position_map(F.col("row"))).alias("k", "column_no")).select("seq_id", (F.col("k") + 1).alias("residue_no"), "column_no")


def gap_columns_removed(spark: SparkSession, folder: str) -> DataFrame:
    return curate.without_empty_columns(_rows(spark, folder)).select("seq_id", "row")


def pairs_listed(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(_rows(spark, folder))


def limited_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(_rows(spark, folder), limit=4)


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return estimate.pair_counts(_weighted(spark, folder)).select("a", "b", "n", F.round("w", 4).alias("w"))


def transition_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _transitions(spark, folder).select("a1", "b1", "a2", "b2", "n", F.round("w", 4).alias("w"))


def transition_prob(spark: SparkSession, folder: str) -> DataFrame:
    sym = estimate.symmetric_transitions(estimate.without_gaps(_transitions(spark, folder)))
    return estimate.transition_probabilities(sym).select("a1", "b1", "a2", "b2", F.round("p", 6).alias("p"))


def symmetrise_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return estimate.symmetric_pairs(estimate.pair_counts(_weighted(spark, folder))).select("a", "b", F.round("w", 4).alias("w"))


def symmetrise_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return estimate.symmetric_transitions(_transitions(spark, folder)).select("a1", "b1", "a2", "b2", F.round("w", 4).alias("w"))


def log_odds_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return estimated_odds(spark, folder).select("a", "b", F.round("score", 6).alias("score"))


def relative_entropy_scale(spark: SparkSession, folder: str) -> DataFrame:
    got = estimate.relative_entropy_scale(estimated_odds(spark, folder))
    return got.select(F.round("relative_entropy", 6).alias("relative_entropy"), F.round("scale", 6).alias("scale"))


def log_odds_bzx(spark: SparkSession, folder: str) -> DataFrame:
    return estimated_matrix(spark, folder).select("a", "b", F.round("score", 6).alias("score"))


def matrix_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated matrix, written as matrix text with three decimals and read again."""
    text = matrix.square_text(estimated_matrix(spark, folder))
    return matrix.parse_square(text).select("a", "b", F.round("score", 3).alias("score"))


def matrix_normalise(spark: SparkSession, folder: str) -> DataFrame:
    got = scoring.normalised(estimated_matrix(spark, folder), scoring.AlignConfig())
    return got.select("a", "b", F.round("d", 6).alias("d"))


def step_cost_table(spark: SparkSession, folder: str) -> DataFrame:
    """Costs, in thousandths, of every step from a pair to a pair, without a transition table; they don't hang on the pair before but for gaps."""
    got = scoring.step_costs(estimated_matrix(spark, folder), None, scoring.AlignConfig())
    return got.select("a1", "b1", "a2", "b2", F.round("cost", 6).alias("cost"))


def boltzmann_table(spark: SparkSession, folder: str) -> DataFrame:
    got = scoring.step_costs(estimated_matrix(spark, folder), None, scoring.AlignConfig())
    return got.select("a1", "b1", "a2", "b2", F.round("boltzmann", 6).alias("boltzmann"))


def matrix_normalise_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as distances by slope alone and by sign alone, and by range with three tenths of the second mixed in."""
    scores = estimated_matrix(spark, folder)
    one, two = (scoring.normalised(scores, scoring.AlignConfig(mode=mode)) for mode in (1, 2))
    mixed = scoring.normalised(scores, scoring.AlignConfig(gamma=0.3), two)
    cells = one.withColumnRenamed("d", "by_slope").join(two.withColumnRenamed("d", "by_sign"), ["a", "b"]).join(mixed.withColumnRenamed("d", "mixed"), ["a", "b"])
    return cells.select("a", "b", *(F.round(c, 6).alias(c) for c in ("by_slope", "by_sign", "mixed")))


def estimated_quantities(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> DataFrame:
    """(a1, b1, a2, b2, q): transition quantities of the alignments in ``sequences``, whose ``counts`` may be given."""
    sym = estimate.symmetric_transitions(estimate.without_gaps(estimate.transition_counts_of(counts) if counts is not None else _transitions(spark, folder)))
    return estimate.transition_quantity(estimate.transition_probabilities(sym))


def step_costs_tq(spark: SparkSession, folder: str) -> DataFrame:
    """Costs and weights of every step from a pair to a pair, by scores and transition quantities of the data."""
    got = scoring.step_costs(estimated_matrix(spark, folder), estimated_quantities(spark, folder), scoring.AlignConfig())
    return got.select("a1", "b1", "a2", "b2", F.round("cost", 6).alias("cost"), F.round("boltzmann", 6).alias("boltzmann"))


def cds_translate(spark: SparkSession, folder: str) -> DataFrame:
    """Proteins of coding sequences; the coding sequences are the records' residues, spelled in codons."""
    return _coding(spark, folder).select("seq_id", R.translated(F.col("dna")).alias("seq"))


def cds_translate_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Proteins of coding sequences, each read by the genetic code of its place, the four codes in turn."""
    rows = _rows(spark, folder).select("seq_id", F.pmod("seq_idx", F.lit(4)).alias("code_no"), curate.coding_sequence(F.regexp_replace("row", "-", "")).alias("dna"))
    return rows.select("seq_id", "code_no", R.translated(F.col("dna"), F.col("code_no")).alias("seq"))


def matrix_average_bzx(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated matrix with plain means for B, Z and X."""
    return matrix.average_ambiguous(estimated_matrix(spark, folder)).select("a", "b", F.round("score", 6).alias("score"))


def cds_backmap(spark: SparkSession, folder: str) -> DataFrame:
    return _coding(spark, folder).select("seq_id", R.back_mapped(F.col("row"), F.col("dna")).alias("dna_row"))


def _coding(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("seq_id", "row", curate.coding_sequence(F.regexp_replace("row", "-", "")).alias("dna"))


def header_sccs(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("seq_id", R.sccs(F.col("a_name")).alias("sccs")).filter("sccs is not null")


def astral_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Name and family as places 1 to 7 and 9 to 15 of headers longer than 16 signs."""
    rows = _rows(spark, folder).filter(F.length("a_name") > 16)
    return rows.select("seq_id", F.substring("a_name", 1, 7).alias("name"), F.substring("a_name", 9, 7).alias("family"))


def name_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).groupBy("a_name").agg(F.count(F.lit(1)).alias("n"))


def count_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences per alignment beside what the older list says: of repeated listings the greatest number."""
    return curate.counted(_rows(spark, folder), table(spark, folder, "frequency_list"))


def split_eq2_gt2(spark: SparkSession, folder: str) -> DataFrame:
    counts = _rows(spark, folder).groupBy("aln_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n >= 2").select("aln_id", F.when(F.col("n") == 2, "eq2").otherwise("gt2").alias("part"))


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    """Alignments by mean identity, in turn to training and test."""
    identity = distance.pair_statistics(_pairs(spark, folder)).groupBy("aln_id").agg(F.round(F.avg("lid"), 6).alias("identity"))
    return curate.alternated(identity, "identity", "aln_id")


def family_vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sequences").select("seq_id", R.sccs(F.col("a_name")).alias("sccs"), "group_no").distinct()
    return family.most_frequent(rows, "sccs", "group_no")


def family_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    """Names that occur in several Groups, less those that also occur under the Group of most records."""
    rows = table(spark, folder, "sequences").select("a_name", "group_no").filter("a_name is not null and group_no is not null")
    return family.black_minus_white(rows)


def group_listings(spark: SparkSession, folder: str) -> DataFrame:
    return family.group_map(table(spark, folder, "summary_group"))


def _score_columns(columns: str) -> str:
    return f"SELECT aln_id, i, j, {columns} FROM stat"


_ENTROPY = COLS + """,
joint0 AS (SELECT aln_id, i, j, x, y, count(*) AS n FROM cols GROUP BY aln_id, i, j, x, y),
joint AS (SELECT *, sum(n) OVER (PARTITION BY aln_id, i, j) AS t FROM joint0),
hx AS (SELECT aln_id, i, j, -sum(p * log2(p)) AS h1 FROM (SELECT aln_id, i, j, x, sum(n) / max(t) AS p FROM joint GROUP BY ALL) GROUP BY ALL),
hy AS (SELECT aln_id, i, j, -sum(p * log2(p)) AS h2 FROM (SELECT aln_id, i, j, y, sum(n) / max(t) AS p FROM joint GROUP BY ALL) GROUP BY ALL),
hxy AS (SELECT aln_id, i, j, -sum(n / t * log2(n / t)) AS h12 FROM joint GROUP BY ALL),
stat AS (SELECT hx.aln_id, hx.i, hx.j, h1, h2, greatest(h1 + h2 - h12, 0) AS mutual FROM hx JOIN hy ON hx.aln_id = hy.aln_id AND hx.i = hy.i AND hx.j = hy.j JOIN hxy ON hx.aln_id = hxy.aln_id AND hx.i = hxy.i AND hx.j = hxy.j)"""
_IDENTITY = COLS + """,
stat AS (SELECT aln_id, i, j, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS gid,
  coalesce(count(*) FILTER (WHERE x = y AND x <> '-') / nullif(count(*) FILTER (WHERE x <> '-' AND y <> '-'), 0), 0) AS lid FROM cols GROUP BY aln_id, i, j)"""
_SHARE = "CASE WHEN {1} > 1e-12 THEN {0} / ({1}) ELSE 0 END"
_ZERO = "CASE WHEN h1 < 1e-12 AND h2 < 1e-12 THEN 0 ELSE {} END"

QUERIES = {
    "fasta_records": fasta_records, "fasta_entries": fasta_entries, "validate_symbols": validate_symbols, "encode_residues": encode_residues, "residue_composition": residue_composition, "degap": degap,
    "lower_case_mask": lower_case_mask, "position_map": position_map, "gap_columns_removed": gap_columns_removed, "all_pairs": pairs_listed, "limited_pairs": limited_pairs,
    "identity_global": _statistics("gid"), "identity_local": _statistics("lid"), "p_distance": _statistics("pdist"), "entropy": _statistics("h1", "h2"), "mutual_information": _statistics("mutual"), "eer": _statistics("eer"), "eer2": _statistics("eer2"), "ecd": _statistics("ecd"), "ecdr": _statistics("ecdr"),
    "pair_counts": pair_counts, "transition_counts": transition_counts, "transition_prob": transition_prob, "tq_local": _quantity("local"), "tq_global": _quantity("global"), "tq_direct": _quantity("direct"), "tq_bzx": tq_bzx,
    "symmetrise_pairs": symmetrise_pairs, "symmetrise_transitions": symmetrise_transitions, "log_odds_matrix": log_odds_matrix, "relative_entropy_scale": relative_entropy_scale, "log_odds_bzx": log_odds_bzx,
    "matrix_round_trip": matrix_round_trip, "matrix_normalise": matrix_normalise, "step_cost_table": step_cost_table, "boltzmann_table": boltzmann_table,
    "matrix_normalise_modes": matrix_normalise_modes, "step_costs_tq": step_costs_tq,
    "cds_translate": cds_translate, "cds_translate_codes": cds_translate_codes, "matrix_average_bzx": matrix_average_bzx, "cds_backmap": cds_backmap, "header_sccs": header_sccs, "astral_slices": astral_slices, "name_frequency": name_frequency, "count_sequences": count_sequences,
    "split_eq2_gt2": split_eq2_gt2, "train_test_split": train_test_split, "family_vote": family_vote, "family_blacklist": family_blacklist, "group_listings": group_listings,
}

_READ = "CASE seq_idx % 4 " + " ".join(f"WHEN {k} THEN translate(replace(arow, '-', ''), '{''.join(curate.CODONS)}BZX', '{''.join(t['TCAG'.index(c[0]) * 16 + 'TCAG'.index(c[1]) * 4 + 'TCAG'.index(c[2])] for c in curate.CODONS.values())}XXX')" for k, t in enumerate(GENETIC_CODES)) + " END"


def _averaged(before: str, name: str, x: int, members: str, n: int) -> str:
    """SQL of one step of averaging: a row and a column as means of others, then where they cross."""
    return f"""{name}m AS (SELECT b, sum(score) / {n} AS score FROM {before} WHERE a IN ({members}) AND b <> {x} GROUP BY b),
{name} AS (SELECT a, b, score FROM {before} WHERE a <> {x} AND b <> {x} UNION ALL SELECT {x}, b, score FROM {name}m UNION ALL SELECT b, {x}, score FROM {name}m UNION ALL SELECT {x}, {x}, sum(score) / {n} FROM {name}m WHERE b IN ({members}))"""


_CODON = "CASE x " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in curate.CODONS.items()) + " ELSE 'NNN' END"
SQL = {
    "fasta_records": """SELECT file_id, CAST(k AS INTEGER) AS record_no, regexp_replace(string_split(part, chr(10))[1], '\\s+$', '') AS name,
  CASE WHEN instr(part, chr(10)) > 0 THEN regexp_replace(substr(part, instr(part, chr(10)) + 1), '\\s', '', 'g') ELSE '' END AS seq
FROM (SELECT file_id, k, parts[k + 1] AS part FROM (SELECT file_id, parts, unnest(range(1, len(parts))) AS k FROM
  (SELECT file_id, string_split(chr(10) || regexp_replace(coalesce(content, ''), '\\r\\n?', chr(10), 'g'), chr(10) || '>') AS parts FROM fasta_files)))""",
    "fasta_entries": f"WITH {ROWS} SELECT aln_id, seq_idx, '>' || coalesce(a_name, '') || chr(10) || regexp_replace(arow, '(.{{60}})', '\\1' || chr(10), 'g') AS entry FROM rows_",
    "validate_symbols": f"WITH {ROWS} SELECT seq_id, seq_idx + 1 AS sequence_no, regexp_replace(raw, '[{ALPHABET[:-2]}{ALPHABET[:-2].lower()}@\\s-]', '', 'g') AS symbols FROM rows_ WHERE regexp_replace(raw, '[{ALPHABET[:-2]}{ALPHABET[:-2].lower()}@\\s-]', '', 'g') <> ''",
    "encode_residues": f"WITH {ROWS} SELECT seq_id, array_to_string(list_transform(string_split(arow, ''), lambda x: CAST(instr('{ALPHABET}', x) - 1 AS VARCHAR)), ' ') AS codes FROM rows_",
    "residue_composition": f"WITH {ROWS}, {SHARES} SELECT a, n, round(f, 9) AS f FROM shares",
    "degap": f"WITH {ROWS} SELECT seq_id, replace(arow, '-', '') AS seq FROM rows_",
    "lower_case_mask": f"WITH {ROWS} SELECT seq_id, regexp_replace(raw, '[a-z]', '-', 'g') AS seq FROM rows_",
    "position_map": f"WITH {ROWS}, cells AS (SELECT seq_id, c, substr(arow, c, 1) AS x FROM (SELECT seq_id, arow, unnest(range(1, length(arow) + 1)) AS c FROM rows_)) SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY c) AS INTEGER) AS residue_no, CAST(c AS INTEGER) AS column_no FROM cells WHERE x <> '-'",
    "gap_columns_removed": f"WITH {ROWS}, cells AS (SELECT seq_id, aln_id, c, substr(arow, c, 1) AS x FROM (SELECT seq_id, aln_id, arow, unnest(range(1, length(arow) + 1)) AS c FROM rows_)), kept AS (SELECT aln_id, c FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE x <> '-') > 0) SELECT seq_id, string_agg(x, '' ORDER BY cells.c) AS row FROM cells JOIN kept ON cells.aln_id = kept.aln_id AND cells.c = kept.c GROUP BY seq_id",
    "all_pairs": f"WITH {PAIRS} SELECT aln_id, i, j FROM pairs",
    "limited_pairs": f"WITH {PAIRS} SELECT aln_id, i, j FROM pairs WHERE i < 4 AND j < 4",
    "identity_global": f"WITH {_IDENTITY} {_score_columns('round(gid, 6) AS gid')}",
    "identity_local": f"WITH {_IDENTITY} {_score_columns('round(lid, 6) AS lid')}",
    "p_distance": f"WITH {_IDENTITY} {_score_columns('round(1 - lid, 6) AS pdist')}",
    "entropy": f"WITH {_ENTROPY} {_score_columns('round(abs(h1), 6) AS h1, round(abs(h2), 6) AS h2')}",
    "mutual_information": f"WITH {_ENTROPY} {_score_columns('round(mutual, 6) AS mutual')}",
    "eer": f"WITH {_ENTROPY} {_score_columns('round(' + _ZERO.format('1 - (' + _SHARE.format('mutual', 'h1') + ' + ' + _SHARE.format('mutual', 'h2') + ') / 2') + ', 6) AS eer')}",
    "eer2": f"WITH {_ENTROPY} {_score_columns('round(' + _ZERO.format('1 - ' + _SHARE.format('mutual', 'h1 + h2 - mutual')) + ', 6) AS eer2')}",
    "ecd": f"WITH {_ENTROPY} {_score_columns('round(h1 - mutual, 6) AS ecd')}",
    "ecdr": f"WITH {_ENTROPY} {_score_columns('round((h1 + h2 - 2 * mutual) / log2(21) / 2, 6) AS ecdr')}",
    "pair_counts": f"WITH {PAIR_COUNTS} SELECT a, b, n, round(w, 4) AS w FROM pc",
    "transition_counts": f"WITH {STEPS} SELECT a1, b1, a2, b2, n, round(w, 4) AS w FROM tc",
    "transition_prob": f"WITH {STEPS} SELECT a1, b1, a2, b2, round(p, 6) AS p FROM prob",
    "tq_local": f"WITH {STEPS} SELECT a1, b1, a2, b2, round(coalesce(-ln(p) / nullif(max(-ln(p)) OVER (PARTITION BY a1, b1), 0), 0), 6) AS q FROM prob",
    "tq_global": f"WITH {STEPS} SELECT a1, b1, a2, b2, round(-ln(p) / max(-ln(p)) OVER (), 6) AS q FROM prob",
    "tq_direct": f"WITH {STEPS} SELECT a1, b1, a2, b2, round(1 - p / max(p) OVER (PARTITION BY a1, b1), 6) AS q FROM prob",
    "tq_bzx": f"""WITH {STEPS}, t AS (SELECT a1, b1, a2, b2, coalesce(-ln(p) / nullif(max(-ln(p)) OVER (PARTITION BY a1, b1), 0), 0) AS q FROM prob),
k AS (SELECT unnest(range(0, 20)) AS k), st AS (SELECT * FROM (VALUES (20, 2), (20, 3), (21, 5), (21, 6)) v(x, m) UNION ALL SELECT 22, k FROM k UNION ALL SELECT k, k FROM k),
g AS (SELECT w.k AS a1, x.k AS b1, y.k AS a2, z.k AS b2 FROM k w, k x, k y, k z), f0 AS (SELECT g.*, coalesce(q, 1.0) AS q FROM g LEFT JOIN t ON t.a1 = g.a1 AND t.b1 = g.b1 AND t.a2 = g.a2 AND t.b2 = g.b2),
f1 AS (SELECT st.x AS a1, b1, a2, b2, avg(q) AS q FROM f0 JOIN st ON st.m = a1 GROUP BY ALL), f2 AS (SELECT a1, st.x AS b1, a2, b2, avg(q) AS q FROM f1 JOIN st ON st.m = b1 GROUP BY ALL),
f3 AS (SELECT a1, b1, st.x AS a2, b2, avg(q) AS q FROM f2 JOIN st ON st.m = a2 GROUP BY ALL), f4 AS (SELECT a1, b1, a2, st.x AS b2, avg(q) AS q FROM f3 JOIN st ON st.m = b2 GROUP BY ALL)
SELECT a1, b1, a2, b2, round(q, 6) AS q FROM f4""",
    "symmetrise_pairs": f"WITH {PAIR_COUNTS} SELECT a, b, round(sum(w) / 2, 4) AS w FROM (SELECT a, b, w FROM pc UNION ALL SELECT b, a, w FROM pc) GROUP BY a, b",
    "symmetrise_transitions": f"WITH {STEPS} SELECT a1, b1, a2, b2, round(sum(w) / 2, 4) AS w FROM (SELECT a1, b1, a2, b2, w FROM tc UNION ALL SELECT b1, a1, b2, a2, w FROM tc) GROUP BY ALL",
    "log_odds_matrix": f"WITH {ODDS} SELECT a, b, round(score, 6) AS score FROM odds",
    "relative_entropy_scale": f"WITH {ODDS}, h AS (SELECT sum(p * score) AS h FROM odds) SELECT round(h, 6) AS relative_entropy, greatest(2.0, round(2 / sqrt(h))) AS scale FROM h",
    "log_odds_bzx": f"WITH {FULL} SELECT a, b, round(score, 6) AS score FROM full_",
    "matrix_round_trip": f"WITH {FULL} SELECT a, b, round(score, 3) AS score FROM full_",
    "matrix_normalise": f"WITH {METRIC} SELECT a, b, round(d, 6) AS d FROM metric",
    "step_cost_table": f"""WITH {METRIC}, k25 AS (SELECT unnest(range(0, 25)) AS k), k24 AS (SELECT unnest(range(0, 24)) AS k)
SELECT a1.k AS a1, b1.k AS b1, a2.k AS a2, b2.k AS b2, round(0.225 * CASE WHEN a2.k < 23 AND b2.k < 23 THEN d WHEN a2.k = 23 AND b2.k = 23 THEN 0
  WHEN (a2.k < 23 AND b1.k = 23) OR (b2.k < 23 AND a1.k = 23) THEN e ELSE o END, 6) AS cost
FROM k25 a1, k25 b1, k24 a2, k24 b2 LEFT JOIN metric ON metric.a = a2.k AND metric.b = b2.k, gaps""".replace("FROM k25 a1, k25 b1, k24 a2, k24 b2 LEFT JOIN metric ON metric.a = a2.k AND metric.b = b2.k, gaps", "FROM k25 a1 CROSS JOIN k25 b1 CROSS JOIN k24 a2 CROSS JOIN k24 b2 CROSS JOIN gaps LEFT JOIN metric ON metric.a = a2.k AND metric.b = b2.k"),
    "boltzmann_table": f"""WITH {METRIC}, k25 AS (SELECT unnest(range(0, 25)) AS k), k24 AS (SELECT unnest(range(0, 24)) AS k)
SELECT a1.k AS a1, b1.k AS b1, a2.k AS a2, b2.k AS b2, round(exp(0.2 * CASE WHEN a2.k < 23 AND b2.k < 23 THEN score WHEN a2.k = 23 AND b2.k = 23 THEN 0
  WHEN (a2.k < 23 AND b1.k = 23) OR (b2.k < 23 AND a1.k = 23) THEN -1 ELSE -22 END), 6) AS boltzmann
FROM k25 a1 CROSS JOIN k25 b1 CROSS JOIN k24 a2 CROSS JOIN k24 b2 LEFT JOIN metric ON metric.a = a2.k AND metric.b = b2.k""",
    "matrix_normalise_modes": f"WITH {METRIC} SELECT a, b, round(-score / (hi - lo), 6) AS by_slope, round(-score, 6) AS by_sign, round(0.7 * d - 0.3 * score, 6) AS mixed FROM metric, r",
    "step_costs_tq": f"""WITH {METRIC}{STEPS.removeprefix(CODED)}, t AS (SELECT a1, b1, a2, b2, coalesce(-ln(p) / nullif(max(-ln(p)) OVER (PARTITION BY a1, b1), 0), 0) AS q FROM prob),
k25 AS (SELECT unnest(range(0, 25)) AS k), k24 AS (SELECT unnest(range(0, 24)) AS k),
st AS (SELECT a1.k AS a1, b1.k AS b1, a2.k AS a2, b2.k AS b2, CASE WHEN a2.k < 23 AND b2.k < 23 THEN 'match' WHEN a2.k = 23 AND b2.k = 23 THEN 'none' WHEN (a2.k < 23 AND b1.k = 23) OR (b2.k < 23 AND a1.k = 23) THEN 'longer' ELSE 'opened' END AS kind
  FROM k25 a1 CROSS JOIN k25 b1 CROSS JOIN k24 a2 CROSS JOIN k24 b2),
full_st AS (SELECT st.*, d, score, o, e, CASE WHEN st.a1 = 24 OR st.b1 = 24 THEN 0 ELSE coalesce(q, 1) END AS q FROM st CROSS JOIN gaps LEFT JOIN metric ON metric.a = st.a2 AND metric.b = st.b2
  LEFT JOIN t ON t.a1 = st.a1 AND t.b1 = st.b1 AND t.a2 = st.a2 AND t.b2 = st.b2)
SELECT a1, b1, a2, b2, round(0.225 * CASE kind WHEN 'match' THEN d WHEN 'none' THEN 0 WHEN 'longer' THEN e ELSE o END + 0.775 * q, 6) AS cost,
  round(exp(0.2 * CASE kind WHEN 'match' THEN score WHEN 'none' THEN 0 WHEN 'longer' THEN -1 ELSE -22 END) * exp(-1.5 * q), 6) AS boltzmann FROM full_st""",
    "cds_translate": f"WITH {ROWS} SELECT seq_id, regexp_replace(replace(arow, '-', ''), '[BZ]', 'X', 'g') AS seq FROM rows_",
    "cds_translate_codes": f"WITH {ROWS} SELECT seq_id, seq_idx % 4 AS code_no, {_READ} AS seq FROM rows_",
    "matrix_average_bzx": f"WITH {FULL}, {_averaged('full_', 'b1', 20, '2, 3', 2)}, {_averaged('b1', 'b2', 21, '5, 6', 2)}, {_averaged('b2', 'b3', 22, ', '.join(map(str, range(22))), 22)} SELECT a, b, round(score, 6) AS score FROM b3",
    "cds_backmap": f"WITH {ROWS} SELECT seq_id, array_to_string(list_transform(string_split(arow, ''), lambda x: CASE WHEN x = '-' THEN '---' ELSE {_CODON} END), '') AS dna_row FROM rows_",
    "header_sccs": f"WITH {ROWS} SELECT * FROM (SELECT seq_id, nullif(regexp_extract(a_name || ' ', '([a-z]\\.\\d\\.\\d\\.\\d)\\D', 1), '') AS sccs FROM rows_) WHERE sccs IS NOT NULL",
    "astral_slices": f"WITH {ROWS} SELECT seq_id, substr(a_name, 1, 7) AS name, substr(a_name, 9, 7) AS family FROM rows_ WHERE length(a_name) > 16",
    "name_frequency": f"WITH {ROWS} SELECT a_name, count(*) AS n FROM rows_ GROUP BY a_name",
    "count_sequences": f"WITH {ROWS}, n AS (SELECT aln_id, count(*) AS n FROM rows_ GROUP BY aln_id), l AS (SELECT aln_id, max(n_listed) AS n_listed FROM frequency_list GROUP BY aln_id) SELECT n.aln_id, n, n_listed, coalesce(n = n_listed, false) AS agrees FROM n LEFT JOIN l ON n.aln_id = l.aln_id",
    "split_eq2_gt2": f"WITH {ROWS} SELECT aln_id, CASE WHEN count(*) = 2 THEN 'eq2' ELSE 'gt2' END AS part FROM rows_ GROUP BY aln_id HAVING count(*) >= 2",
    "train_test_split": f"WITH {_IDENTITY}, m AS (SELECT aln_id, round(avg(lid), 6) AS identity FROM stat GROUP BY aln_id) SELECT aln_id, identity, CASE WHEN row_number() OVER (ORDER BY identity, aln_id) % 2 = 1 THEN 'train' ELSE 'test' END AS part FROM m",
    "family_vote": "WITH s AS (SELECT DISTINCT seq_id, nullif(regexp_extract(a_name || ' ', '([a-z]\\.\\d\\.\\d\\.\\d)\\D', 1), '') AS sccs, group_no FROM sequences), n AS (SELECT sccs, group_no, count(*) AS n FROM s WHERE sccs IS NOT NULL AND group_no IS NOT NULL GROUP BY ALL) SELECT sccs, group_no, n FROM n QUALIFY row_number() OVER (PARTITION BY sccs ORDER BY n DESC, group_no) = 1",
    "family_blacklist": "WITH s AS (SELECT DISTINCT a_name, group_no FROM sequences WHERE a_name IS NOT NULL AND group_no IS NOT NULL), top AS (SELECT group_no FROM sequences WHERE a_name IS NOT NULL AND group_no IS NOT NULL GROUP BY group_no ORDER BY count(*) DESC, group_no LIMIT 1) SELECT a_name FROM s GROUP BY a_name HAVING count(*) > 1 EXCEPT SELECT a_name FROM s WHERE group_no IN (SELECT group_no FROM top)",
    "group_listings": "SELECT row_no, TRY_CAST(nullif(regexp_extract(group_label, '[0-9]+'), '') AS BIGINT) AS group_no, CASE WHEN regexp_matches(scop_sunid, '[1-9]') THEN array_to_string(list_transform(regexp_extract_all(scop_sunid, '([0-9]+)(\\.[0-9]+)?', 1), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') END AS sunids, matrix_file, gap_init, gap_ext FROM summary_group",
}
