"""Vocabularies ``(namespace, token, idx)`` and word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.numbering import ranked_within

PADDING, OOV = "@@PADDING@@", "@@UNKNOWN@@"


def token_counts(texts: DataFrame, namespace: str, text: str, pattern: str = "[a-z0-9]+") -> DataFrame:
    """(namespace, token, n)."""
    rows = texts.select(F.col(namespace).alias("namespace"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("token"))
    return rows.groupBy("namespace", "token").agg(F.count("*").alias("n"))


def build_vocab(counts: DataFrame, min_count: int = 1, max_size: int | None = None, oov: int = 1, include: list[str] | None = None, exclude: list[str] | None = None, pretrained: DataFrame | None = None, need_both: bool = False) -> DataFrame:
    """(namespace, token, idx): tokens by falling count (ties by token), from 1 + oov on; 0 is padding, then the OOV slots.

    A token stays with min_count occurrences, or, with ``pretrained`` words (column word), when it is one of them;
    ``need_both`` asks for both. Ranks come from one exact numbering over (namespace, count, token), so no task holds a namespace.
    """
    rows = counts
    if include:
        rows = rows.filter(F.col("namespace").isin(*include))
    if exclude:
        rows = rows.filter(~F.col("namespace").isin(*exclude))
    enough = F.col("n") >= min_count
    if pretrained is not None:
        rows = rows.join(pretrained.select(F.col("word").alias("token"), F.lit(True).alias("_p")).distinct(), "token", "left")
        known = F.coalesce("_p", F.lit(False))
        enough = (enough & known) if need_both else (enough | known)
    rows = ranked_within(rows.filter(enough).select("namespace", "token", "n"), ["namespace"], [F.desc("n"), "token"], "_r")
    if max_size is not None:
        rows = rows.filter(F.col("_r") <= max_size)
    return rows.select("namespace", "token", (F.col("_r") + oov).cast("int").alias("idx"))


def special_tokens(namespaces: DataFrame, oov: int = 1) -> DataFrame:
    """Padding at 0 and the OOV slots from 1 on, for each namespace."""
    names = F.array(F.lit(PADDING), *[F.lit(OOV if oov == 1 else f"{OOV}{i}") for i in range(oov)])
    return namespaces.select("namespace").distinct().select("namespace", F.posexplode(names).alias("idx", "token")).select("namespace", "token", "idx")


def sha1_mod(token: Column, n: int) -> Column:
    """sha1(token) as a number, mod n, in five 32-bit steps."""
    digest, r = F.sha1(token.cast("binary")), F.lit(0).cast("decimal(38,0)")
    for i in range(5):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
        r = F.pmod(r * F.lit(1 << 32).cast("decimal(20,0)") + chunk, F.lit(n).cast("decimal(20,0)")).cast("decimal(18,0)")
    return r.cast("long")


def token_index(tokens: DataFrame, vocab: DataFrame, oov: int = 2600) -> DataFrame:
    """Rows of (namespace, token) get ``idx``: the vocabulary's, else an OOV slot by hash (one slot: 1)."""
    slot = F.lit(1) if oov == 1 else 1 + sha1_mod(F.col("token"), oov)
    return tokens.join(vocab, ["namespace", "token"], "left").withColumn("idx", F.coalesce("idx", slot).cast("long"))


def set_special_index(vocab: DataFrame, namespace: str, token: str, idx: int) -> DataFrame:
    """Gives a token a fixed negative index. A non-negative one is an error, an index in use one at run time."""
    if idx >= 0:
        raise ValueError("special indices are negative")
    row = vocab.sparkSession.createDataFrame([(namespace, token, idx)], "namespace string, token string, idx int")
    both = vocab.unionByName(row)
    n = F.count("*").over(Window.partitionBy("namespace", "idx"))
    checked = F.when((n > 1) & (F.col("idx") == idx), F.raise_error(F.lit(f"index {idx} is in use")).cast("int")).otherwise(F.col("idx"))
    return both.withColumn("idx", checked)


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.partitionBy("namespace").mode("errorifexists").parquet(path)


def load_vocab(spark, path: str) -> DataFrame:
    return spark.read.schema("token string, idx int, namespace string").parquet(path).select("namespace", "token", "idx")


def vocab_vectors(vocab: DataFrame, vectors: DataFrame, width: int, seed: int = 12) -> DataFrame:
    """(token, idx, vec): the word's vector, else normal numbers with the mean and deviation of all kept values, seeded by the token."""
    kept = vectors.join(vocab.select(F.col("token").alias("word")).distinct(), "word", "left_semi")
    stats = kept.select(F.explode("vec").alias("x")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))  # one row

    def uniform(i: int, j: int) -> Column:
        return (F.conv(F.substring(F.md5(F.concat_ws("|", "token", F.lit(f"{seed}|{i}|{j}"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)

    normal = F.array(*[F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1)) for i in range(width)])
    rows = vocab.join(vectors, vocab["token"] == vectors["word"], "left").crossJoin(F.broadcast(stats))
    drawn = F.transform(normal, lambda z: (F.coalesce("mean", F.lit(0.0)) + F.coalesce("std", F.lit(1.0)) * z).cast("float"))
    return rows.select("token", "idx", F.coalesce("vec", drawn).alias("vec"))


def pretrained_words(lines: DataFrame) -> DataFrame:
    """The set of first words of vector lines (column value)."""
    return lines.select(F.split_part("value", F.lit(" "), F.lit(1)).alias("word")).distinct()
