"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence meet in one posterior over the languages that the corpus
declares:

*   the text: a naive Bayes likelihood over hashed byte trigrams, its counts
    summed by language over every row that declares one;
*   the declared language (markup, or a column), and
*   the suffix of the address, each through the probability of what was declared
    given the language, from sums of the texts' own posteriors;
*   the site: a prior for each level of its name (suffix, domain, host), each
    level shrunk toward the one above and the first toward the whole corpus.

All tables come from grouped aggregation with partial sums; a site that holds a
third of the rows is one row on the small side of its join.  A row is rejected
when no language reaches ``ACCEPT`` or its text has no letters.

Cases: a null or empty text has no likelihood and no letters, its posterior is
that of the other evidence and it is rejected; null or unknown declarations,
suffixes and sites say nothing; with no declared language in the whole table
there is no language and every row is rejected; ties go to the first language in
alphabetical order; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches, text_digest, without_rows

#: Hashed trigrams of the model.
BUCKETS = 1 << 14
#: Strength of the level above, in rows.
SHRINK = 10.0
#: A text counts as this many trigrams at most, in the likelihood as trigrams hang
#: together, in the counts so that no long text speaks for its language.
WEIGHT = 200
UNIT = 4096
#: Numbers that a worker adds up at once for one text.
AT_ONCE = 4_000_000
ACCEPT = 0.6


def _buckets(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the text's trigrams, spaces at both ends."""
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)


def _letters(text: str) -> bytes:
    """The text in lower case (A-Z and what else has a lower case)."""
    return " ".join(text.lower().split()).encode()


def code(declared: Column) -> Column:
    """``de-AT`` and ``DE`` are ``de``; what is no code is null."""
    first = F.lower(F.trim(F.split(declared, "[-_]")[0]))
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


def _counts(rows: DataFrame) -> DataFrame:
    """language, bucket, n over the rows (text, declared) that declare a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen = _buckets(_letters(text.as_py()))
                # In units of 1/UNIT, so that sums don't hang on their order; a long text is no more than WEIGHT trigrams.
                counts += np.rint(np.bincount(seen, minlength=BUCKETS) * (UNIT * min(1.0, WEIGHT / max(1, len(seen))))).astype(np.int64)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["language", "bucket", "n"]
            )

    labelled = rows.where("declared is not null and text is not null").select("text", "declared")
    return labelled.mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """log P(bucket | language), smoothed by one; bounded by codes of two or three letters times buckets."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages = languages
        self.log_p = log_p

    def likelihood(self, text: str | None) -> tuple[np.ndarray, bool]:
        """Log likelihoods less the largest, and whether the text has letters."""
        sums = np.zeros(len(self.languages))
        if not text:
            return sums, False
        seen = _buckets(_letters(text))
        step = max(1, AT_ONCE // max(1, len(sums)))
        for i in range(0, len(seen), step):
            sums += self.log_p[seen[i : i + step]].sum(0, dtype=np.float64)
        sums *= min(1.0, WEIGHT / max(1, len(seen)))
        return sums - sums.max(initial=-np.inf) if len(sums) else sums, any(c.isalpha() for c in text)


def train(rows: DataFrame) -> Model:
    """From rows (text, declared); what comes to the driver is one count for each language and bucket."""
    found = cut(_counts(rows), "trigrams")
    table = found.toPandas()
    languages = sorted(table["language"].unique())
    at = table["language"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    counts = table["n"].to_numpy(float) / UNIT
    total = np.bincount(at, counts, len(languages)) + BUCKETS
    log_p = np.empty((BUCKETS, len(languages)), np.float32)
    log_p[:] = np.log(1.0 / total)
    log_p[table["bucket"].to_numpy(int), at] = np.log((counts + 1.0) / total[at])
    return Model(languages, log_p)


def _with_softmax(df: DataFrame, logs: str, out: str) -> DataFrame:
    """``df`` with the normalised exponentials of ``logs``, a step a column so that each is computed once."""
    return (
        df.withColumn("top_", F.array_max(logs))
        .withColumn("parts_", F.transform(logs, lambda x: F.exp(x - F.col("top_"))))
        .withColumn("total_", F.aggregate("parts_", F.lit(0.0), lambda s, x: s + x))
        .withColumn(out, F.transform("parts_", lambda x: x / F.col("total_")))
        .drop("top_", "parts_", "total_")
    )


def _added(logs: Column, more: str) -> Column:
    return F.transform(logs, lambda x, i: x + F.coalesce(F.get(F.col(more), i), F.lit(0.0)))


def _sums(df: DataFrame, by: list[str]) -> DataFrame:
    """``sums`` of ``text_p`` by language, and the rows, for each value of ``by``: added up in rows of one language each."""
    each = df.select(*by, F.posexplode("text_p").alias("at", "p")).groupBy(*by, "at").agg(F.sum("p").alias("s"), F.count("*").alias("rows"))
    return each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "s")))["s"].alias("sums"), F.max("rows").alias("rows"))


def _constant(values: list, kind: str) -> Column:
    """An array of many values as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def identify(rows: DataFrame, levels: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """id, declared, language, posterior, accepted for rows (id, text, declared, suffix, and ``levels``).

    ``levels`` are the columns of the site's name, from the widest to the
    narrowest; ``declared`` holds codes as ``code`` gives them; ``carried`` are
    binary columns that come along.
    """
    spark = rows.sparkSession
    small_batches(spark)
    model = train(rows)
    n = len(model.languages)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.likelihood(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * n, pa.int32()), pa.array(np.concatenate([f[0] for f in found] or [np.empty(0)]))), pa.array([f[1] for f in found], pa.bool_())],
                [*batch.schema.names[1:], "text_log", "letters"],
            )

    kept = list(dict.fromkeys(["id", "declared", "suffix", *levels, *carried]))
    kinds = ", ".join(f"{c} {'long' if c == 'id' else 'binary' if c in carried else 'string'}" for c in kept)
    scored = rows.select("text", *kept).mapInArrow(run, f"{kinds}, text_log array<double>, letters boolean")
    scored = cut(_with_softmax(scored, "text_log", "text_p"), "likelihoods")

    seen = scored.where("letters")
    whole = {r["at"]: r.s for r in seen.select(F.posexplode("text_p").alias("at", "p")).groupBy("at").agg(F.sum("p").alias("s")).collect()}
    sums = [float(whole.get(i, 0)) for i in range(n)]
    prior = [(s + 1.0) / (sum(sums) + n) for s in sums]
    fused = scored.withColumn("site", _constant(prior, "double"))
    for k, level in enumerate(levels):
        # A level's name is unique only below the names above it.
        by = levels[: k + 1]
        table = _sums(seen.where(F.col(level).isNotNull()), by).select(*[F.col(c).alias(f"{c}_") for c in by], "sums", "rows")
        on = [F.col(c).eqNullSafe(F.col(f"{c}_")) if c != level else F.col(c) == F.col(f"{c}_") for c in by]
        # A row's own text is left out of its site's sums: it speaks for itself already.
        own = F.when(F.col("letters"), 1.0).otherwise(0.0)
        shrunk = F.transform(
            "site",
            lambda p, i: (F.greatest(F.get(F.col("sums"), i) - own * F.get(F.col("text_p"), i), F.lit(0.0)) + SHRINK * p) / (F.col("rows") - own + SHRINK),
        )
        fused = (
            fused.join(table, _all(on), "left")
            .withColumn("site", F.when(F.col("rows").isNotNull(), shrunk).otherwise(F.col("site")))
            .drop("sums", "rows", *[f"{c}_" for c in by])
        )
    logs = F.transform("text_log", lambda x, i: x + F.log(F.get(F.col("site"), i)))
    for evidence in ("declared", "suffix"):
        # P(value | language) from the texts' posteriors, one row of doubt for each language.
        table = _sums(seen.where(F.col(evidence).isNotNull()), [evidence]).select(F.col(evidence).alias("value_"), F.col("sums").alias("sums_"))
        share = F.transform(
            _constant(sums, "double"),
            lambda s, i: F.log((F.coalesce(F.get(F.col("sums_"), i), F.lit(0.0)) + 0.5) / (s + 1.0)),
        )
        fused = fused.join(table, F.col(evidence) == F.col("value_"), "left").withColumn(
            f"log_{evidence}", F.when(F.col("sums_").isNotNull(), share)
        ).drop("value_", "sums_")
        logs = _added(logs, f"log_{evidence}")
    posterior = _with_softmax(fused.withColumn("logs", logs), "logs", "p").select("id", "declared", "letters", "p", *carried)
    top = F.array_max("p")
    named = _constant(model.languages, "string")
    return posterior.select(
        "id",
        "declared",
        F.get(named, (F.array_position("p", top) - 1).cast("int")).alias("language"),
        F.round(top, 6).alias("posterior"),
        F.coalesce(F.col("letters") & (top >= ACCEPT), F.lit(False)).alias("accepted"),
        *carried,
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def document_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Documents as evidence: their language column is what they declare, their source is the site."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), "text", code(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), *more
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's lang, the address's suffix, domain and host."""
    address = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(address != "", address)
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        visible.alias("text"),
        code(declared).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.substring_index(host, ".", -2).alias("domain"),
        host.alias("host"),
    )


def _evidence(docs: DataFrame) -> Column:
    """A digest of all that a document's verdict hangs on: language column, source and text."""
    said = [F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in (docs[x].cast("string") for x in ("lang", "source"))]
    return text_digest(F.concat(*said, F.coalesce(F.concat(F.lit("+"), docs["text"]), F.lit("-"))))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) whose language is accepted, each by its own evidence."""
    rows = document_rows(docs, _evidence(docs).alias("evidence"))
    found = identify(rows, ["host"], ("evidence",))
    return without_rows(docs, found.where("not accepted").select(F.col("id").alias("doc_id"), F.col("evidence").alias("key")), _evidence(docs))
