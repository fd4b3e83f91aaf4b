"""Mixing sources to target weights by iterative proportional fitting, with DataFrame and SQL functions only.

Tokens (words) are counted per cell of source, language and topic. Cell weights, begun at the counted tokens, are raked:
scaled in turn so that their sums by source, by language and by topic meet the target marginals, SWEEPS times over. A
document is then kept with its cell's calibrated probability, min(1, s * fitted / counted), where the scale s is raised in
CAP_ROUNDS so that the expected tokens come near FRACTION of all in spite of cells that are used up. Whether it is kept is
decided by a hash of its id, so the sample is the same on every run.

The default targets dampen the counted shares (power TEMPER); a table of own targets may be given for any margin. The topic
is a column, or by default the form of the text: capitals, symbols, lists or prose in three lengths.

Texts are counted with map-side sums and then joined with the cells, a table of one row per distinct cell; Spark sends it
to all executors if it is small, and else splits the hot cells of the join.

Cases: null source, language or topic is a value of its own; null and empty texts count no tokens, their cells' probability is
1 if they have no other texts; a margin value without target gets the weight 0; rows with an equal id are kept or dropped
together if they are of one cell, rows without an id each by their text; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import SPACES, own_columns, store, text_of, unused

SWEEPS, CAP_ROUNDS, FRACTION, TEMPER = 12, 6, 0.7, 0.7
MARGINS = ("source", "lang", "topic")
#: Sweeps in one query plan; longer plans cost more planning than work.
SWEEPS_PER_PLAN = 3


TOPIC = """CASE WHEN 2 * length(regexp_replace({t}, '[^A-Z]+', '{g}')) > length(regexp_replace({t}, '[^A-Za-z]+', '{g}')) THEN 'capitals'
  WHEN 20 * (length({t}) - length(regexp_replace({t}, '[#*$%&]+', '{g}'))) > length({t}) THEN 'symbols'
  WHEN 40 * (length({t}) - length(replace({t}, '|', ''))) > length({t}) THEN 'list'
  WHEN length({t}) < 600 THEN 'short' WHEN length({t}) < 6000 THEN 'prose' ELSE 'long' END"""


def form(text: str = "coalesce(CAST(text AS STRING), '')") -> Column:
    """The form of a non-null text. Only ASCII letters count for capitals."""
    return F.expr(TOPIC.replace("'{g}')", "'')").format(t=text))


def marks() -> list[Column]:
    """Source and language; null is a value of its own."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in MARGINS[:2]]


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, the margins (null as its own value), tokens and chance of each document."""
    body = F.btrim(text_of(), F.lit(SPACES))
    tokens = F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+")))
    return docs.select("doc_id", *[m.alias(f"_{c}") for m, c in zip(marks(), MARGINS)], (topic if topic is not None else form()).alias("_topic"),
                       tokens.cast("long").alias("_tokens"), chance().alias("_chance"))


def target_sql(margin: str, cells: str) -> str:
    return (f"SELECT m, w / sum(w) OVER () AS share FROM (SELECT _{margin} AS m, power(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS w "
            f"FROM {cells} GROUP BY _{margin}) AS q")


def start_sql(cells: str, targets: tuple[str, str, str]) -> str:
    """Cells with their three target sums of tokens."""
    joins = " ".join(f"LEFT JOIN ({t}) AS t{i} ON c._{m} = t{i}.m" for i, (m, t) in enumerate(zip(MARGINS, targets)))
    shares = ", ".join(f"coalesce(t{i}.share, 0) * total AS g{i}" for i in range(3))
    return f"SELECT c._source, c._lang, c._topic, c.tokens, c.total, {shares}, CAST(c.tokens AS DOUBLE) AS w FROM (SELECT *, sum(tokens) OVER () AS total FROM {cells}) AS c {joins}"


def sweep_sql(q: str) -> str:
    """One round of raking: by source, by language, by topic."""
    for i, m in enumerate(MARGINS):
        q = f"SELECT _source, _lang, _topic, tokens, total, g0, g1, g2, CASE WHEN s > 0 THEN w * g{i} / s ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY _{m}) AS s FROM ({q}) AS a{i}) AS b{i}"
    return q


def probabilities_sql(q: str) -> str:
    """Calibrated probability of each cell; to twelve digits, so that the order of sums can't show."""
    q = f"SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS ratio, CAST({FRACTION} AS DOUBLE) AS scale FROM ({q}) AS z"
    for k in range(CAP_ROUNDS):
        q = f"""SELECT _source, _lang, _topic, tokens, total, w, ratio, CASE WHEN open > 0 THEN greatest(scale, ({FRACTION} * total - spent) / open) ELSE scale END AS scale FROM (
          SELECT *, sum(CASE WHEN scale * ratio >= 1 THEN CAST(tokens AS DOUBLE) ELSE 0 END) OVER () AS spent, sum(CASE WHEN scale * ratio < 1 THEN w ELSE 0 END) OVER () AS open FROM ({q}) AS c{k}) AS d{k}"""
    return f"SELECT _source, _lang, _topic, tokens, w AS fitted, round(least(1, scale * ratio), 12) AS probability FROM ({q}) AS p"


def fit(described_docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with tokens, fitted tokens and probability. targets: per margin a table (m, share); m is '=' and the value, '' for null."""
    spark = described_docs.sparkSession
    cells = store(described_docs.groupBy(*[f"_{m}" for m in MARGINS]).agg(F.sum("_tokens").alias("tokens")), "mix-cells")
    own = targets or {}
    queries = tuple(f"SELECT m, share FROM {{t{i}}}" if m in own else target_sql(m, "{c}") for i, m in enumerate(MARGINS))
    given = {f"t{i}": own[m] for i, m in enumerate(MARGINS) if m in own}
    q = spark.sql(start_sql("{c}", queries), c=cells, **given)
    for done in range(0, SWEEPS, SWEEPS_PER_PLAN):
        sql = "SELECT * FROM {q}"
        for _ in range(min(SWEEPS_PER_PLAN, SWEEPS - done)):
            sql = sweep_sql(sql)
        q = store(spark.sql(sql, q=q), "mix-weights")
    return store(spark.sql(probabilities_sql("SELECT * FROM {q}"), q=q), "mix-probabilities")


def chance(id_column: str = "doc_id") -> Column:
    """A number from 0 to below 1 from a hash of the id, or of the text of a row without an id."""
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("="), text_of()))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def decided(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """doc_id, margins, tokens, probability and sampled of each document. Texts are described once."""
    rows = store(described(docs, topic), "mix-documents")
    cells = fit(rows, targets).drop("tokens")
    return rows.join(cells, [f"_{m}" for m in MARGINS]).withColumn("sampled", F.col("_chance") < F.col("probability"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled documents with all their columns. Each meets its cell's probability as it is read; texts aren't shuffled."""
    *names, share = unused(docs, *[f"_cell_{m}" for m in MARGINS], "_cell_p")
    rows = store(described(docs), "mix-documents")
    cells = fit(rows, targets).select(*[F.col(f"_{m}").alias(n) for m, n in zip(MARGINS, names)], F.col("probability").alias(share))
    source, lang, topic = (key == F.col(n) for key, n in zip([*marks(), form()], names))
    return docs.join(cells, source & lang & topic).where(chance() < F.col(share)).select(*own_columns(docs))


def oracle() -> str:
    """DuckDB SQL of decided(documents)."""
    words = r"len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))"
    topic = TOPIC.replace("'{g}')", "'', 'g')").format(t="t")
    q = "SELECT * FROM start"
    for _ in range(SWEEPS):
        q = sweep_sql(q)
    return f"""WITH docs AS (SELECT doc_id, coalesce('=' || source, '') AS _source, coalesce('=' || lang, '') AS _lang, {topic} AS _topic, {words} AS n, coalesce(CAST(doc_id AS VARCHAR), '=' || t) AS name
          FROM (SELECT *, coalesce(text, '') AS t FROM documents) AS d),
        cells AS (SELECT _source, _lang, _topic, sum(n) AS tokens FROM docs GROUP BY 1, 2, 3),
        start AS ({start_sql('cells', tuple(target_sql(m, 'cells') for m in MARGINS))}),
        fitted AS MATERIALIZED ({q}), chances AS ({probabilities_sql('SELECT * FROM fitted')})
        SELECT doc_id, _topic AS topic, CAST(n AS BIGINT) AS tokens, probability, ('0x' || substr(md5(name), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled
        FROM docs JOIN chances USING (_source, _lang, _topic)"""
