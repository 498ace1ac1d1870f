"""Column functions: titles, tokens, brackets, evidence, labels. Native expressions unless stated."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that n-grams, keys and overlaps ignore.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
    shan shouldn wasn weren won wouldn 'll 're 've n't 's 'd 'm '' ``
    """.split()
)
# Bracket tokens and what they stand for.
BRACKETS = (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}"), ("-COLON-", ":"))
BRACKET_PAIRS = (("-LRB-", "-RRB-"), ("-LSB-", "-RSB-"), ("-LCB-", "-RCB-"), ("-lrb-", "-rrb-"), ("-lsb-", "-rsb-"), ("-lcb-", "-rcb-"))
LABELS = ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")
EMPTY_TEXT = "@@@EMPTY@@@"
#: Texts of an Arrow batch that are Python strings at a time.
NFD_ROWS = 64
#: Our token rule: bracket tokens, words with inner apostrophes, hyphens or points, or one sign.
TOKEN = r"-(?:[LR][RSC]B|COLON)-|[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text and titles


def nfd(c: Column | str) -> Column:
    """Unicode NFD. Spark has no such function: an Arrow UDF, which only gets the texts that aren't plain ASCII, and holds ``NFD_ROWS`` of a batch as Python strings at a time."""

    @F.arrow_udf("string")
    def decompose(texts: pa.Array) -> pa.Array:
        cuts = [texts.slice(at, NFD_ROWS) for at in range(0, len(texts), NFD_ROWS)] or [texts]
        return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFD", t) for t in cut.to_pylist()], pa.string()) for cut in cuts])

    c = _col(c)
    return F.coalesce(decompose(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)), c)


def brc_decode(c: Column | str) -> Column:
    """Bracket tokens to the signs they stand for."""
    c = _col(c)
    for token, sign in BRACKETS:
        c = F.replace(c, F.lit(token), F.lit(sign))
    return c


def brc_encode(c: Column | str, spaces: bool = False) -> Column:
    """The reverse of brc_decode; with ``spaces`` spaces become underscores too."""
    c = _col(c)
    for token, sign in BRACKETS:
        c = F.replace(c, F.lit(sign), F.lit(token))
    return F.replace(c, F.lit(" "), F.lit("_")) if spaces else c


def tokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0))


def natural_title(c: Column | str) -> Column:
    """A doc id as running text: brackets decoded, underscores as spaces, tokens joined by one space."""
    return F.array_join(tokenize(F.translate(brc_decode(c), "_", " ")), " ")


def title_tokens(c: Column | str) -> Column:
    """A doc id's tokens with brackets as bracket tokens."""
    return F.filter(F.split(F.regexp_replace(F.translate(_col(c), "_", " "), r"(-(?:[LR][RSC]B|COLON)-)", " $1 "), r"\s+"), lambda w: w != "")


def is_filtered_word(word: Column) -> Column:
    """A stop word, or signs only."""
    return word.rlike(r"^\p{P}+$") | F.lower(word).isin(*STOP_WORDS)


def filter_ngram(gram: Column | str, mode: str = "any") -> Column:
    """Whether an n-gram (array) is to be dropped: any, all or one of the end words are filtered."""
    gram = _col(gram)
    if mode == "any":
        return F.exists(gram, is_filtered_word)
    if mode == "all":
        return F.forall(gram, is_filtered_word)
    if mode == "ends":
        return is_filtered_word(F.element_at(gram, 1)) | is_filtered_word(F.element_at(gram, -1))
    raise ValueError(f"unknown mode {mode}")


def filter_doc_id(c: Column | str) -> Column:
    """Whether a doc id is to be dropped: no ASCII letter, or a letter of an Arabic range."""
    c = _col(c)
    arabic = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿\x{10E60}-\x{10E7F}\x{1EE00}-\x{1EEFF}]"
    return ~c.rlike("[a-zA-Z]") | c.rlike(arabic)


# --- brackets in token arrays


def _folded(tokens: Column) -> Column:
    """Depth of each bracket pair, whether a depth fell below zero, and the tokens inside and outside."""
    n = len(BRACKET_PAIRS)
    start = F.struct(F.array_repeat(F.lit(0), n).alias("depth"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("inside"), F.array().cast("array<string>").alias("outside"))
    pairs = F.array(*[F.struct(F.lit(left).alias("l"), F.lit(right).alias("r")) for left, right in BRACKET_PAIRS])
    marks = _array([m for p in BRACKET_PAIRS for m in p])

    def step(acc: Column, t: Column) -> Column:
        depth = F.zip_with(acc["depth"], pairs, lambda d, p: d + F.when(t == p["l"], 1).when(t == p["r"], -1).otherwise(0))
        below = F.exists(depth, lambda d: d < 0)
        depth = F.transform(depth, lambda d: F.greatest(d, F.lit(0)))
        mark, deep = F.array_contains(marks, t), F.exists(acc["depth"], lambda d: d > 0)
        return F.struct(
            depth.alias("depth"),
            (acc["ok"] & ~below).alias("ok"),
            F.when(~mark & deep, F.array_append(acc["inside"], t)).otherwise(acc["inside"]).alias("inside"),
            F.when(~mark & ~deep, F.array_append(acc["outside"], t)).otherwise(acc["outside"]).alias("outside"),
        )

    return F.aggregate(tokens, start, step)


def balanced_brackets(tokens: Column | str) -> Column:
    done = _folded(_col(tokens))
    return done["ok"] & F.forall(done["depth"], lambda d: d == 0)


def words_inside_brackets(tokens: Column | str) -> Column:
    return _folded(_col(tokens))["inside"]


def remove_brackets(tokens: Column | str) -> Column:
    """Tokens outside brackets; empty when nothing was removed."""
    tokens = _col(tokens)
    outside = _folded(tokens)["outside"]
    return F.when(F.size(outside) == F.size(tokens), F.array().cast("array<string>")).otherwise(outside)


def bracket_overlap_score(title: Column | str, title_lemmas: Column | str, claim: Column | str, claim_lemmas: Column | str, plain: bool = False) -> Column:
    """3.0 if words in the title's brackets meet the claim's tokens, 2.0 if their lemmas do, else 1.0; ``plain``: without lower-casing and stop words."""

    def clean(x: Column) -> Column:
        return x if plain else F.array_except(F.transform(x, F.lower), _array(STOP_WORDS))

    def words(x: Column) -> Column:
        return x if plain else F.transform(x, F.lower)

    met = F.arrays_overlap(clean(words_inside_brackets(title)), words(_col(claim)))
    by_lemma = F.arrays_overlap(clean(words_inside_brackets(title_lemmas)), words(_col(claim_lemmas)))
    return F.when(F.coalesce(met, F.lit(False)), 3.0).when(F.coalesce(by_lemma, F.lit(False)), 2.0).otherwise(1.0)


def media_bonus(title: Column | str) -> Column:
    inside = words_inside_brackets(title)
    return F.when(F.array_contains(inside, "film"), 0.2).when(F.array_contains(inside, "album") | F.array_contains(inside, "TV"), 0.1).otherwise(0.0)


# --- numbered lines and packed ids


def split_numbered_lines(c: Column | str) -> Column:
    """``0\\tsentence\\tanchor\\ttarget...\\n1\\t...`` -> array of (line_num, text, h_links).

    A line starts only at the number that follows the one before; once a number is missing the rest stays in one line.
    Links are dropped if ``thumb`` is among them, empty links always; newlines inside a line are removed.
    """
    parts = F.split(F.concat(F.lit("\n"), _col(c)), r"\n(?=\d+\t)")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("next"), F.lit(False).alias("broken"))

    def step(acc: Column, p: Column) -> Column:
        fits = ~acc["broken"] & (F.split_part(p, F.lit("\t"), F.lit(1)) == acc["next"].cast("string"))
        glued = F.concat(F.slice(acc["lines"], 1, F.greatest(F.size(acc["lines"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["lines"], -1), p)))
        lines = F.when(fits, F.array_append(acc["lines"], p)).when(F.size(acc["lines"]) > 0, glued).otherwise(acc["lines"])
        return F.struct(lines.alias("lines"), F.when(fits, acc["next"] + 1).otherwise(acc["next"]).alias("next"), (acc["broken"] | ~fits).alias("broken"))

    lines = F.aggregate(parts, start, step)["lines"]

    def line(p: Column) -> Column:
        cells = F.split(F.replace(p, F.lit("\n"), F.lit("")), "\t")
        links = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
        links = F.when(F.array_contains(links, "thumb"), F.array().cast("array<string>")).otherwise(F.filter(links, lambda x: x != ""))
        return F.struct(cells[0].cast("int").alias("line_num"), F.trim(F.get(cells, F.lit(1))).alias("text"), links.alias("h_links"))

    return F.transform(lines, line)


def pack_id(*parts: Column | str, separator: str = "<SENT_LINE>") -> Column:
    return F.concat_ws(separator, *[_col(p).cast("string") for p in parts])


def unpack_id(c: Column | str, separator: str = "<SENT_LINE>") -> Column:
    """A struct of doc_id and line_num from a packed sentence id."""
    c = _col(c)
    return F.struct(F.split_part(c, F.lit(separator), F.lit(1)).alias("doc_id"), F.split_part(c, F.lit(separator), F.lit(2)).cast("int").alias("line_num"))


def to_scoring_format(ids: Column | str) -> Column:
    return F.transform(_col(ids), lambda x: unpack_id(x))


# --- evidence


def normalize_evidence(groups: Column | str) -> Column:
    """Per group: no nulls, distinct, sorted by (doc, line); then distinct groups. ``groups``: array of arrays of (doc_id, line_num)."""
    clean = F.transform(_col(groups), lambda g: F.array_sort(F.array_distinct(F.filter(g, lambda e: e["doc_id"].isNotNull() & e["line_num"].isNotNull()))))
    return F.array_distinct(clean)


def evidence_from_tuples(groups: Column | str) -> Column:
    """Groups of (annotation, evidence, doc, line) string tuples -> groups of (doc_id, line_num)."""
    return F.transform(_col(groups), lambda g: F.transform(g, lambda t: F.struct(F.get(t, F.lit(2)).alias("doc_id"), F.get(t, F.lit(3)).cast("int").alias("line_num"))))


def validate_evidence(evidence: Column | str) -> Column:
    """The evidence if all its entries have a doc and a line; an error at run time otherwise."""
    evidence = _col(evidence)
    bad = F.exists(evidence, lambda e: e["doc_id"].isNull() | e["line_num"].isNull())
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("predicted evidence must be (doc, line) pairs"))).otherwise(evidence)


def token_spans(sentences: Column | str) -> Column:
    """Offsets [start, end) of each sentence (array of token arrays) in their concatenation; they are consecutive by construction."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        return F.array_append(acc, F.struct(at.alias("start"), (at + F.size(s)).alias("end")))

    return F.aggregate(_col(sentences), start, step)


def truncate_tokens(text: Column | str, max_l: int) -> Column:
    """The first max_l tokens of space-separated text; an empty text becomes a placeholder."""
    text = _col(text)
    filled = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, F.lit(EMPTY_TEXT)).otherwise(text)
    return F.array_join(F.slice(F.split(F.trim(filled), r"\s+"), 1, max_l), " ")


# --- scores


def softmax(logits: Column | str) -> Column:
    logits = _col(logits)
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax_label(logits: Column | str, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of the largest logit, the first one on ties."""
    logits = _col(logits)
    return F.element_at(_array(labels), F.array_position(logits, F.array_max(logits)).cast("int"))


def joint_scores(logits: Column | str) -> Column:
    """(probs, score, prob) from three label logits and one selection logit."""
    logits = _col(logits)
    last = F.element_at(logits, 4)
    return F.struct(softmax(F.slice(logits, 1, 3)).alias("probs"), (-last).alias("score"), (1 - 1 / (1 + F.exp(-last))).alias("prob"))


def number_bucket(token: Column | str, buckets: int = 20_000) -> Column:
    """A bucket (of the token's md5, which other SQL engines can repeat) for tokens of one to five digits, else null."""
    token = _col(token)
    return F.when(token.rlike(r"^\d{1,5}$"), (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int"))


def position_weight(position: Column | str, count: Column | str, k: int = 5, start: float = 1.1, end: float = 0.8) -> Column:
    """Weights that fall geometrically from start to end over the first min(count, k) positions (from 0), null beyond."""
    position, n = _col(position), F.least(_col(count), F.lit(k))
    share = F.when(n > 1, position / (n - 1)).otherwise(0.0)
    return F.when(position < n, F.lit(start) * F.pow(F.lit(end / start), share))
