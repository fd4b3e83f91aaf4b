r"""Quality rules: robust multivariate outliers, with DataFrame and SQL functions only.

Each text gets plain counts (words `[^\x20\x09-\x0D]+`, characters in words, symbols, repeated lines, words in repeated
8-word windows). Two base rules reject very short and very repetitive texts. The others' statistic vectors (mean word
length, symbols, repeated lines, repeated words, capitals; logs, roots and shares) are judged per language and source:
the minimum covariance determinant is approached by concentration steps from coordinate-wise medians, each keeping the half
of a group that lies nearest and refitting mean and covariance on it; texts beyond the chi-square cutoff of the robust
Mahalanobis distance are rejected.

Texts are read once; all later work is on the table of counts, and per group only sums and histograms of at most some
hundred bins are formed, so a source with a third of all rows is no bigger task than another. Quantiles are those of fixed
bins, so the result doesn't depend on how rows are dealt.

Cases: null and empty texts have no words and fail; null languages and sources form groups of their own; a group of one
text keeps it; rows repeated or with equal doc_id are each judged; an empty table gives no rows; other columns are ignored
by measure() and kept by reject().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import SPACES, drop_stored, store, text_of

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
#: Spread that each statistic has at least: mean word length (log), symbols (root), lines, repeats, capitals (shares).
FLOORS = (0.08, 0.05, 0.06, 0.06, 0.05)
DIMENSIONS, STEPS, CUTOFF_TAIL = len(FLOORS), 3, 1e-5
BINS = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_square_below(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees, by its series."""
    term = total = 1 / (k / 2)
    i = 0
    while term > total * 1e-15:
        i += 1
        term *= (x / 2) / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, k) < p else (low, mid)
    return high


HALF = 0.5
#: Makes the covariance of the nearest half consistent for normal data.
CONSISTENCY = HALF / chi_square_below(chi_square_quantile(HALF, DIMENSIONS), DIMENSIONS + 2)
CUTOFF = chi_square_quantile(1 - CUTOFF_TAIL, DIMENSIONS)


def repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the words' hashes. Windows are only sorted where one recurs."""
    n = F.size(hashes)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW)))))
    return F.coalesce(windows, F.array().cast("array<bigint>"))


def covered(windows: Column) -> Column:
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        def again(j: Column) -> Column:
            h = F.get(s, j)["h"]
            return (F.get(s, j - 1)["h"].eqNullSafe(h)) | (F.get(s, j + 1)["h"].eqNullSafe(h))
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), again)
        return F.array_sort(F.transform(found, lambda j: F.get(s, j)["i"]))

    # one-element transform: the sorted array is bound once and not evaluated for each use
    at = F.transform(F.array(pairs), places)[0]
    start = F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("t"))
    return F.aggregate(at, start, lambda a, p: F.struct((p + WINDOW).alias("e"), (a["t"] + (p + WINDOW - F.greatest(a["e"], p))).cast("long").alias("t")), lambda a: a["t"])


def measure(docs: DataFrame, *keep: str, text_column: str = "text") -> DataFrame:
    """The kept columns, the counts of each text, its number of lines with a word and of capitals."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.select(*keep, text_of(text_column).alias("_text"))
    df = df.withColumns({"_body": F.btrim(text, F.lit(SPACES)), "_lines": lines})
    df = df.withColumn("_words", F.when(F.col("_body") == "", F.array().cast("array<string>")).otherwise(F.split("_body", r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    df = df.withColumn("_windows", repeat_words(F.col("_hashes")))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), covered(F.col("_windows"))).otherwise(0)
    return df.select(*keep, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     symbols.cast("long").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     repeats.cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
                     (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"))


FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"
#: The vector of a text; twenty words of five letters steady the mean word length of short texts.
VECTOR = ("ln((word_chars + 100.0) / (n_words + 20.0))", "sqrt(n_symbols / (word_chars + 1.0))",
          "n_dup_lines / greatest(1.0, CAST(n_lines AS DOUBLE))", "CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1)",
          "n_capitals / (word_chars + 1.0)")
_D = range(1, DIMENSIONS + 1)


def vectors_sql(counts: str) -> str:
    """Vectors of the texts that pass the base rules; g is the group."""
    z = ", ".join(f"CAST({v} AS DOUBLE) AS z{i}" for i, v in zip(_D, VECTOR))
    return f"SELECT doc_id, coalesce('=' || lang, '') || chr(10) || coalesce('=' || source, '') AS g, {z} FROM {counts} WHERE NOT {FAILED}"


def medians_sql(vectors: str) -> str:
    """First fit of each group: medians to 1/BINS, and the floors as spreads."""
    cells = " UNION ALL ".join(f"SELECT g, {i} AS d, CAST(floor(z{i} * {BINS}) AS BIGINT) AS b FROM {vectors}" for i in _D)
    factor = ", ".join(f"CAST({FLOORS[i - 1] if i == j else 0} AS DOUBLE) AS l{i}{j}" for i in _D for j in _D if j <= i)
    means = ", ".join(f"max(CASE WHEN d = {i} THEN m END) AS m{i}" for i in _D)
    return f"""SELECT g, {means}, {factor} FROM (
        SELECT g, d, CAST(min(b) AS DOUBLE) / {BINS} AS m FROM (
          SELECT g, d, b, sum(n) OVER (PARTITION BY g, d ORDER BY b) AS c, sum(n) OVER (PARTITION BY g, d) AS t FROM (
            SELECT g, d, b, count(*) AS n FROM ({cells}) AS cells GROUP BY g, d, b) AS bins) AS cum
        WHERE 2 * c >= t GROUP BY g, d) AS medians GROUP BY g"""


def distances_sql(vectors: str, fit: str) -> str:
    """Squared Mahalanobis distance to the group's fit: forward substitution with the Cholesky factor."""
    own = ", ".join(f"m{i}" for i in _D) + ", " + ", ".join(f"l{i}{j}" for i in _D for j in _D if j <= i)
    q = f"SELECT v.*, {own} FROM {vectors} AS v JOIN {fit} AS f ON v.g = f.g"
    for i in _D:
        rest = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        q = f"SELECT *, (z{i} - m{i}{rest}) / l{i}{i} AS y{i} FROM ({q}) AS s{i}"
    z = ", ".join(f"z{i}" for i in _D)
    return f"SELECT doc_id, g, {z}, {' + '.join(f'y{i} * y{i}' for i in _D)} AS d2 FROM ({q}) AS d"


def step_sql(distances: str) -> str:
    """One concentration step: mean and covariance of the nearest half of each group, its Cholesky factor."""
    moments = ", ".join(f"avg(z{i}) AS m{i}" for i in _D) + ", " + ", ".join(f"avg(z{i} * z{j}) AS p{i}{j}" for i in _D for j in _D if j <= i)
    q = f"""SELECT b.g, {moments} FROM (SELECT *, CAST(floor(8 * ln(1 + d2)) AS BIGINT) AS bin FROM {distances}) AS b JOIN (
          SELECT g, min(bin) AS most FROM (
            SELECT g, bin, sum(n) OVER (PARTITION BY g ORDER BY bin) AS c, sum(n) OVER (PARTITION BY g) AS t FROM (
              SELECT g, CAST(floor(8 * ln(1 + d2)) AS BIGINT) AS bin, count(*) AS n FROM {distances} GROUP BY 1, 2) AS bins) AS cum
          WHERE 2 * c >= t GROUP BY g) AS h ON b.g = h.g AND b.bin <= h.most GROUP BY b.g"""
    cov = ", ".join(f"greatest(p{i}{j} - m{i} * m{j}, 0) * {CONSISTENCY!r} + {FLOORS[i - 1] ** 2!r} AS c{i}{j}" if i == j
                    else f"(p{i}{j} - m{i} * m{j}) * {CONSISTENCY!r} AS c{i}{j}" for i in _D for j in _D if j <= i)
    q = f"SELECT g, {', '.join(f'm{i}' for i in _D)}, {cov} FROM ({q}) AS k"
    for j in _D:
        rest = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        q = f"SELECT *, sqrt(greatest(c{j}{j}{rest}, {FLOORS[j - 1] ** 2 * 0.1!r})) AS l{j}{j} FROM ({q}) AS a{j}"
        lower = ", ".join(f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(1, j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIMENSIONS + 1))
        if lower:
            q = f"SELECT *, {lower} FROM ({q}) AS b{j}"
    factor = ", ".join(f"l{i}{j}" for i in _D for j in _D if j <= i)
    return f"SELECT g, {', '.join(f'm{i}' for i in _D)}, {factor} FROM ({q}) AS f"


def verdicts(counts: DataFrame) -> DataFrame:
    """The counts, base_failed, the squared distance (null if base_failed) and kept. Needs doc_id, lang and source."""
    spark = counts.sparkSession
    counts = counts.withColumn("_row", F.monotonically_increasing_id())
    counts = store(counts, "quality-counts")
    vectors = spark.sql(vectors_sql("{c}").replace("doc_id,", "_row AS doc_id,", 1), c=counts)
    fit = store(spark.sql(medians_sql("{v}"), v=vectors), "quality-fit")
    for _ in range(STEPS):
        distances = spark.sql(distances_sql("{v}", "{f}"), v=vectors, f=fit)
        following = store(spark.sql(step_sql("{d}"), d=distances), "quality-fit")
        drop_stored(fit)
        fit = following
    own = spark.sql(distances_sql("{v}", "{f}"), v=vectors, f=fit).select(F.col("doc_id").alias("_row"), F.col("d2").alias("distance"))
    return (counts.join(own, "_row", "left").drop("_row")
            .withColumn("base_failed", F.expr(FAILED)).withColumn("kept", F.expr(f"NOT {FAILED} AND coalesce(distance <= {CUTOFF!r}, true)")))


def reject(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. Documents are found again by id and a hash of the text."""
    text_key = F.xxhash64(text_of())
    judged = verdicts(measure(docs.withColumn("_key", text_key), "doc_id", "lang", "source", "_key"))
    bad = judged.where("NOT kept").select(F.col("doc_id").alias("_bad_id"), F.col("_key").alias("_bad_key"), F.coalesce("lang", F.lit("")).alias("_bad_lang"), F.coalesce("source", F.lit("")).alias("_bad_source")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_key == bad["_bad_key"])
                     & (F.coalesce(docs["lang"], F.lit("")) == bad["_bad_lang"]) & (F.coalesce(docs["source"], F.lit("")) == bad["_bad_source"]), "left_anti")


def oracle() -> str:
    """DuckDB SQL of verdicts(measure(documents)): list functions for the counts, the same definition of the fit."""
    space = r"[\x20\x09-\x0D]"
    counts = rf"""SELECT doc_id, lang, source, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS wc,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals, w
      FROM (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM (SELECT *, coalesce(text, '') AS t FROM documents) AS d) AS p"""
    windows = f"""SELECT doc_id, i, h, count(*) OVER (PARTITION BY doc_id, h) AS k FROM (
        SELECT doc_id, unnest(range(len(w) - {WINDOW - 1})) AS i, unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda i: md5(list_aggregate(w[i + 1:i + {WINDOW}], 'string_agg', chr(10))))) AS h
        FROM base WHERE len(w) >= {WINDOW}) AS x"""
    repeats = f"""SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words FROM (
        SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM windows WHERE k > 1) AS y GROUP BY doc_id"""
    ctes = [f"base AS ({counts})", f"windows AS ({windows})", f"repeats AS ({repeats})",
            "counts AS (SELECT b.doc_id, lang, source, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_lines, n_capitals FROM base AS b LEFT JOIN repeats AS r ON b.doc_id = r.doc_id)",
            f"v AS ({vectors_sql('counts')})", f"f0 AS ({medians_sql('v')})"]
    for k in range(STEPS):
        ctes += [f"d{k} AS ({distances_sql('v', f'f{k}')})", f"f{k + 1} AS ({step_sql(f'd{k}')})"]
    ctes.append(f"last AS ({distances_sql('v', f'f{STEPS}')})")
    return f"""WITH {', '.join(ctes)} SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {FAILED} AS base_failed,
        NOT {FAILED} AND coalesce(d2 <= {CUTOFF!r}, true) AS kept FROM counts AS c LEFT JOIN last ON c.doc_id = last.doc_id"""
