"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is the multiset of its words, a word's weight its count. For every word and every sample
number, hashes give r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln(weight) / r + b) the word's value is ln(c) - r * (t - b + 1), and the sample is the word
(with its t) of least value. Two texts agree in a sample with probability equal to the generalised
Jaccard similarity of their weights, sum of minima over sum of maxima. A fingerprint keeps 16 bits
per sample, so accidental agreement adds at most 2**-16.

Rows are dealt out once by document id; words, counts and minima are then computed where the text
is, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize

#: Samples per fingerprint: BLOCKS groups of SAMPLES that are aggregated together.
BLOCKS, SAMPLES = 8, 8
#: Ids per chunk when neighbours are found, and most chunks.
CHUNK, MOST_CHUNKS = 50_000, 4096
#: Mark of what a text and its edited form share (0: the text's own, 1: the edited form's).
BOTH = 2
#: Tasks per shuffle partition: counting words needs much more memory than the texts take.
FINER = 4

_WORD = r"[\x20\x09-\x0D]+"


def next_ids(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``n``, ``next_id``): the next smaller id, the largest after the smallest; ``n`` characters.

    Ids are cut into chunks at approximate quantiles; neighbours are found inside chunks, and the
    chunks' largest ids (one row per chunk) tie the chunks together.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ids = materialize(ids, "ids")
    parts = min(MOST_CHUNKS, 1 + ids.count() // CHUNK)
    splits = sorted(set(ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # Quantiles come as doubles: rounded ones still cut consistently.
    chunk = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col("doc_id").cast("double"))) if splits else F.lit(0)
    ids = ids.withColumn("chunk", chunk)
    tops = ids.groupBy("chunk").agg(F.max("doc_id").alias("top"))
    whole = Window.orderBy(F.col("chunk").desc())
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("chunk", F.coalesce(F.lead("top").over(whole), F.first("top").over(every)).alias("beyond"))
    inside = F.lead("doc_id").over(Window.partitionBy("chunk").orderBy(F.col("doc_id").desc()))
    return ids.withColumn("inside", inside).join(F.broadcast(tops), "chunk").select(
        "doc_id", "n", F.coalesce("inside", "beyond").alias("next_id"))


def _unit(bits: Column) -> Column:
    """Uniform number strictly between 0 and 1 from the lower 32 bits."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(float(1 << 32))


def _value(seed: Column, j: int) -> Column:
    """Value of a word (log weight ``lw``) for one sample."""
    x = F.xxhash64(seed, F.lit(j))
    y, z = F.xxhash64(x), F.xxhash64(x, F.lit(1))
    r = -F.ln(_unit(x) * _unit(F.shiftrightunsigned(x, 32)))
    c = -F.ln(_unit(y) * _unit(F.shiftrightunsigned(y, 32)))
    b = _unit(z)
    return F.ln(c) - r * (F.floor(F.col("lw") / r + b) - b + F.lit(1.0))


def samples(texts: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``own`` and ``changed``: 16-bit codes of the least values of the words of each row's two bodies.

    ``texts`` holds ``key`` and parts of the bodies: ``side`` (0: own, 1: changed, BOTH) and ``body``; no word may
    reach over two parts. Where it is partitioned by some of ``key`` nothing moves. A body without words has null,
    a row without any is left out. A word that has one weight in both bodies gets its values once.
    """
    words = texts.select(*key, "side", F.explode(F.split(F.lower("body"), _WORD)).alias("word")).where("word <> ''")
    counted = words.select(*key, "side", F.xxhash64("word").alias("h")).groupBy(*key, "h").agg(
        F.count_if(F.col("side") != 1).alias("w0"), F.count_if(F.col("side") != 0).alias("w1"))
    weight = lambda side, w: F.struct(F.lit(side).alias("in"), F.ln(w.cast("double")).alias("lw"))
    weights = F.when(F.col("w0") == F.col("w1"), F.array(weight(BOTH, F.col("w0")))).when(
        F.col("w1") == 0, F.array(weight(0, F.col("w0")))).when(F.col("w0") == 0, F.array(weight(1, F.col("w1")))).otherwise(
        F.array(weight(0, F.col("w0")), weight(1, F.col("w1"))))
    weighed = counted.select(*key, "h", F.explode(weights).alias("e")).select(*key, "h", "e.in", "e.lw")
    blocks = weighed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn(
        "seed", F.xxhash64("h", "block"))
    least = blocks.groupBy(*key, "block", "in").agg(*[F.min(_value(F.col("seed"), j)).alias(f"m{j}") for j in range(SAMPLES)])
    # As many entries as blocks: the least of a body's own words and of the shared ones.
    of = lambda side, j: F.min(F.when(F.col("in").isin(side, BOTH), F.col(f"m{j}")))
    least = least.groupBy(*key, "block").agg(*[of(side, j).alias(f"s{side}m{j}") for side in (0, 1) for j in range(SAMPLES)])
    code = lambda m: F.xxhash64(m).bitwiseAND(F.lit(0xFFFF)).cast("int")
    codes = lambda side: F.when(F.col(f"s{side}m0").isNotNull(), F.struct("block", F.array(
        *[code(F.col(f"s{side}m{j}")) for j in range(SAMPLES)]).alias("c")))
    coded = least.select(*key, codes(0).alias("c0"), codes(1).alias("c1"))
    gathered = coded.groupBy(*key).agg(*[F.array_sort(F.collect_list(f"c{side}")).alias(f"g{side}") for side in (0, 1)])
    whole = lambda side: F.when(F.size(f"g{side}") > 0, F.flatten(f"g{side}.c"))
    return gathered.select(*key, whole(0).alias("own"), whole(1).alias("changed"))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal samples: two texts without words are alike (1), one of them without is unlike any other (0)."""
    same = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, v: t + v)
    return F.when(x.isNull() & y.isNull(), F.lit(1.0)).when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(
        same / F.lit(float(BLOCKS * SAMPLES)))


def text_of(sampled: Column) -> Column:
    """Hexadecimal form, four digits per sample; without words all zeros."""
    digits = F.array_join(F.transform(sampled, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), "")
    return F.coalesce(digits, F.lit("0" * (4 * BLOCKS * SAMPLES)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness, one row per row of ``docs``.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. A null text is empty. The edited text has its last third (rounded
    down) replaced by as many first characters of the next document in descending order of id. Rows
    with one id are each edited with the same next document; where the next id has several texts the
    least counts. A row with a null id has no next document: its tail is cut off and ``near_next`` is
    null. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    following = materialize(next_ids(rows), "next-ids")
    named, loose = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    repeated = not named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    # Dealt out once; every later use of the texts reads this exchange again.
    dealt = named.repartition(n, "doc_id")
    single = dealt.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else dealt
    wanted = following.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "n")
    heads = single.join(wanted.repartition(n, "doc_id"), "doc_id").select(
        F.col("for_id").alias("doc_id"), F.substring("text", F.lit(1), _third(F.col("n"))).alias("head"),
        F.col("doc_id").alias("next_id")).repartition(n, "doc_id")
    known = _both(dealt.join(heads, "doc_id"), repeated)
    if not loose.isEmpty():
        alone = loose.withColumn("head", F.lit("")).withColumn("next_id", F.lit(None).cast("long"))
        known = known.unionByName(_both(alone.repartition(n, F.xxhash64("text")), True))
    known = materialize(known, "fingerprints")
    beside = known.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("own", "body_id").alias("beside")) if repeated \
        else known.select(F.col("doc_id").alias("next_id"), F.col("own").alias("beside"))
    out = known.join(beside.where(F.col("next_id").isNotNull()), "next_id", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.when(F.col("next_id").isNotNull(), likeness(F.col("own"), F.col("beside"))).alias("near_next"))


def _third(n: Column) -> Column:
    return F.floor(n / 3).cast("int")


def _both(whole: DataFrame, repeated: bool) -> DataFrame:
    """Samples of each text (``own``) and of its edited form (``changed``), with the facts that are reported."""
    whole = whole.select("doc_id", "text", "head", "next_id", F.length("text").alias("n_chars"), F.xxhash64("text").alias("body_id"))
    tail = _third(F.col("n_chars"))
    whole = whole.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - tail), F.substring("head", F.lit(1), tail)))
    facts = whole.select("doc_id", "body_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"),
                         F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    distinct = whole.dropDuplicates(["doc_id", "body_id"]) if repeated else whole
    # Words of the kept part are counted once: it is split off behind its last white space, as its last word may go on.
    kept = F.substring("text", F.lit(1), F.col("n_chars") - tail)
    begun = F.length(F.split(F.reverse(kept), _WORD, 2)[0])
    distinct = distinct.withColumn("cut", F.col("n_chars") - tail - begun)
    rest = lambda body: F.substring(body, F.col("cut") + 1, F.length(body))
    sides = distinct.select("doc_id", "body_id", "next_id", F.explode(F.array(
        F.struct(F.lit(BOTH).alias("side"), F.substring("text", F.lit(1), F.col("cut")).alias("body")),
        F.struct(F.lit(0).alias("side"), rest("text").alias("body")),
        F.struct(F.lit(1).alias("side"), rest("edited").alias("body")))).alias("s")).select(
        "doc_id", "body_id", "next_id", "s.side", "s.body")
    # The next id is carried along so that both uses of the heads' exchange ask for the same columns.
    pair = samples(sides, ["doc_id", "body_id", "next_id"]).select(
        F.col("doc_id").alias("id"), F.col("body_id").alias("bid"), "own", "changed")
    # Where ids are unique they are the key, by which both sides are dealt out already.
    same = (facts["body_id"] == pair["bid"]) & facts["doc_id"].eqNullSafe(pair["id"]) if repeated \
        else facts["doc_id"] == pair["id"]
    return facts.join(pair, same, "left").drop("id", "bid")
