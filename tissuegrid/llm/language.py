"""Language identification by Bayesian evidence fusion.

Four kinds of evidence give the posterior of a row's language:

* the text: hashed byte trigrams under a multinomial model per language, with a tempering exponent,
  as overlapping trigrams are not independent;
* the declared language of the markup (or of the metadata), through the observed confusion between
  declarations and what the text says;
* the address suffix and the host, as priors smoothed along a hierarchy: all rows, suffix,
  registered domain, host. Each level's prior is its own soft count plus ``SMOOTH`` times the prior
  above it; a row's own share is taken out of every count, so that it does not vote for itself.

All counts come from grouped aggregations over the whole table: trigram counts per declared
language, then soft counts of text-only posteriors per suffix, domain, host and declaration. They
meet the rows by joins, so a host with a third of all rows is a sum combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize, with_missing
from tissuegrid.llm.textarrays import batches

LANGUAGES = ("de", "en", "es", "fr")
BITS = 14
#: Exponent of the trigram likelihood.
TEMPER = 0.3
#: Pseudo-count of a level's parent in its prior.
SMOOTH = 20.0
#: Posterior from which a language is accepted, and letters (bytes of words) a text must have.
ACCEPT, LETTERS = 0.6, 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every byte trigram that is not mostly blank, and letters per text."""
    buffer = _FOLD[np.frombuffer(b" ".join([*raw, b" "]), dtype=np.uint8)]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    x = buffer.astype(np.uint32)
    letter = buffer != 32
    use = np.flatnonzero(letter[1:-1] & (letter[:-2] | letter[2:]))
    code = (x[use] << 16) | (x[use + 1] << 8) | x[use + 2]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    letters = np.bincount(np.searchsorted(ends, np.flatnonzero(letter), side="right"), minlength=len(raw))
    return bucket.astype(np.int64), np.searchsorted(ends, use + 1, side="right"), letters[:len(raw)]


def page_evidence(pages: DataFrame) -> DataFrame:
    """(``page_id``, ``text``, ``declared``, ``host``) of raw pages (``url``, ``html``)."""
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("text"),
                        F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``, ``declared``, ``host``) of documents (``lang``, ``source``)."""
    docs = with_missing(docs, lang="string", source="string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.lower("lang").alias("declared"), F.lower("source").alias("host"))


def train(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probabilities (bucket x language) from all rows whose declaration is one of ``languages``.

    Each task sends its counts once; what reaches the driver is ``2**BITS`` counts per language.
    """
    index = {c: i for i, c in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), 1 << BITS), dtype=np.int64)
        for frame in frames:
            owner_language = frame["declared"].map(index).to_numpy(dtype=np.int64)
            for first, raw in batches(frame["text"]):
                bucket, owner, _ = trigrams(raw)
                at = owner_language[first + owner] * (1 << BITS) + bucket
                total += np.bincount(at, minlength=total.size).reshape(total.shape)
        language, bucket = np.nonzero(total)
        yield pd.DataFrame({"language": language, "bucket": bucket, "n": total[language, bucket]})

    counts = rows.where(F.col("declared").isin(*languages)).select("text", "declared").mapInPandas(
        count, "language int, bucket int, n long")
    summed = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << BITS, len(languages)), 0.5)
    table[summed["bucket"].to_numpy(dtype=np.int64), summed["language"].to_numpy(dtype=np.int64)] += summed["n"].to_numpy()
    return np.log(table / table.sum(axis=0))


def _text_evidence(rows: DataFrame, model: np.ndarray, key: list[str]) -> DataFrame:
    """Log likelihood per language of each row, up to a constant, and its letters."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{k} long" for k in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            for first, raw in batches(frame["text"]):
                bucket, owner, letters = trigrams(raw)
                total = np.zeros((len(raw), table.shape[1]))
                for j in range(table.shape[1]):
                    total[:, j] = np.bincount(owner, weights=table[bucket, j], minlength=len(raw))[:len(raw)]
                total -= total.max(axis=1, keepdims=True)
                part = frame.iloc[first:first + len(raw)]
                yield part[[*key, "declared", "host"]].assign(evidence=list(total), letters=letters)

    return rows.select(*key, "declared", "host", "text").mapInPandas(
        run, f"{kinds}, declared string, host string, evidence array<double>, letters long")


def identify(
    rows: DataFrame, key: list[str], languages: tuple[str, ...] = LANGUAGES, temper: float = TEMPER,
    smooth: float = SMOOTH, accept: float = ACCEPT, letters: int = LETTERS,
) -> DataFrame:
    """``key`` columns, ``declared``, ``host``, ``lang``, ``probability`` and ``accepted``, one row per row.

    ``rows`` holds the long ``key`` columns, ``text``, ``declared`` and ``host``. Missing evidence (null
    text, declaration or host) leaves the posterior to the rest. A row is accepted when it has at
    least ``letters`` letters and its best language reaches ``accept``; a null or empty text is
    rejected, its language is that of the other evidence. Ties go to the first language. Repeated
    rows and null keys are rows like any other.
    """
    n = len(languages)
    model = train(rows, languages)
    # Stored: the texts are read once here, all later steps work on a few numbers per row.
    scored = materialize(_text_evidence(rows, model, key), "evidence")
    suffix = F.when(F.col("host").contains("."), F.regexp_extract("host", r"\.([^.]+)$", 1)).otherwise(F.lit(""))
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), "host", F.lit(""))
    scored = scored.withColumn("suffix", F.coalesce(suffix, F.lit(""))).withColumn("domain", domain).withColumn(
        "site", F.coalesce("host", F.lit(""))).withColumn("said", F.coalesce("declared", F.lit("")))
    spoken = [F.element_at("evidence", i + 1) * temper for i in range(n)]
    # What the text alone says; the evidence's greatest entry is zero.
    scored = scored.withColumn("spoken", F.transform("evidence", lambda x: F.exp(x * temper)))
    scored = scored.withColumn("heard", F.when(F.col("letters") > 0, F.transform(
        "spoken", lambda x: x / F.aggregate("spoken", F.lit(0.0), lambda t, o: t + o))))

    def soft(*by: str) -> DataFrame:
        return scored.where(F.col("heard").isNotNull()).groupBy(*by).agg(
            F.array(*[F.sum(F.element_at("heard", i + 1)) for i in range(n)]).alias(f"{by[-1]}_n"))

    # Soft counts of all rows: as many numbers as languages.
    whole = scored.where(F.col("heard").isNotNull()).agg(
        *[F.coalesce(F.sum(F.element_at("heard", i + 1)), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    out = scored
    for level in ("suffix", "domain", "site", "said"):
        out = out.join(materialize(soft(level), f"soft-{level}"), level, "left")
    # Each step is a column of its own, used several times by the next, so that no expression is repeated.
    item = lambda c, i: F.element_at(c, i + 1)
    none = F.array(*[F.lit(0.0)] * n)
    out = out.withColumn("own", F.coalesce("heard", none))
    total = float(sum(whole))
    out = out.withColumn("root", F.array(*[
        (F.lit(whole[i] + 1.0) - item("own", i)) / (F.lit(total + n) - F.when(F.col("heard").isNull(), 0.0).otherwise(1.0))
        for i in range(n)]))
    prior = "root"
    for level in ("suffix", "domain", "site", "said"):
        counts, size, above = f"{level}_c", f"{level}_s", "root" if level == "said" else prior
        out = out.withColumn(counts, F.zip_with(F.coalesce(f"{level}_n", none), "own", lambda c, o: F.greatest(c - o, F.lit(0.0))))
        out = out.withColumn(size, F.aggregate(counts, F.lit(0.0), lambda t, c: t + c))
        out = out.withColumn(f"{level}_p", F.array(*[
            (item(counts, i) + smooth * item(above, i)) / (F.col(size) + smooth) for i in range(n)]))
        prior = f"{level}_p"
    # The declaration counts by P(declared | language) relative to P(declared).
    told = F.col("said") != ""
    out = out.withColumn("logs", F.array(*[
        F.ln(item("site_p", i)) + F.when(told, F.ln(item("said_p", i)) - F.ln(item("root", i))).otherwise(0.0)
        + F.when(F.col("letters") > 0, spoken[i]).otherwise(0.0) for i in range(n)]))
    out = out.withColumn("top", F.array_max("logs"))
    out = out.withColumn("odds", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    out = out.withColumn("posterior", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda t, o: t + o)))
    out = out.withColumn("probability", F.array_max("posterior"))
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("posterior", F.col("probability")).cast("int"))
    # Stored: a filter on the result would be rewritten in terms of all the steps above.
    return materialize(out.select(
        *key, "declared", "host", best.alias("lang"), F.round("probability", 9).alias("probability"),
        ((F.col("letters") >= letters) & (F.col("probability") >= accept)).alias("accepted")), "languages")
