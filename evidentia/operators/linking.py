"""Linking claims to documents by longest matches of title keywords.

Tables: keyword index ``(keyword, doc_id, priority)``; claims ``(claim_id, tokens)``; links ``(claim_id, match_key, start, stop,
doc_id, priority)``. Keywords form a trie of two levels: a head (the first two words, or the only one) and the lengths of the
keywords that begin with it. Each place of a claim looks up its heads; only where a head is known are n-grams of these lengths
made and looked up. Each claim's spans are swept from left to right in one array expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.plans.scratch import written

EXACT, STRIPPED = 5.0, 1.0
#: Keywords, or heads, up to which they are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_KEYWORDS = 100_000
ARTICLES = ("The", "A", "An")


def build_keyword_index(titles: DataFrame, brackets: bool = True, keep_disambiguation: bool = False, priorities: bool = True) -> DataFrame:
    """(keyword, doc_id, priority) from (doc_id, keyword): exact titles, and titles without their bracketed part.

    A document whose id contains ``disambiguation`` gets no stripped keyword unless kept; nor do titles with unbalanced
    brackets. The same keyword and document keep the higher priority. The flags give the older forms: no stripped
    keywords, or no priorities (all 1.0).
    """
    exact = titles.select("keyword", "doc_id", F.lit(EXACT if priorities else STRIPPED).alias("priority"))
    if not brackets:
        return exact.groupBy("keyword", "doc_id").agg(F.max("priority").alias("priority"))
    tokens = titles.withColumn("_t", F.split("keyword", " ")).filter(F.col("keyword").rlike("-[LlRr][RSCrsc][Bb]-"))
    if not keep_disambiguation:
        tokens = tokens.filter(~F.col("doc_id").contains("disambiguation"))
    tokens = tokens.filter(C.balanced_brackets("_t")).withColumn("_o", C.remove_brackets("_t")).filter(F.size("_o") > 0)
    stripped = tokens.select(F.array_join("_o", " ").alias("keyword"), "doc_id", F.lit(STRIPPED).alias("priority"))
    return exact.unionByName(stripped).groupBy("keyword", "doc_id").agg(F.max("priority").alias("priority"))


def is_noise_keyword(keyword: Column) -> Column:
    """Numbers 0..99999 without leading zeros, ordinals of 0..999, stop words in lower or title case."""
    number = keyword.rlike(r"^(0|[1-9]\d{0,4})$")
    ordinal = keyword.rlike(r"^(0|[1-9]\d{0,2})(st|nd|rd|th)$")
    n = F.regexp_extract(keyword, r"^(\d+)", 1).try_cast("int")
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    stop = keyword.isin(*C.STOP_WORDS, *[w.title() for w in C.STOP_WORDS])
    return number | (ordinal & keyword.endswith(suffix)) | stop


def drop_noise_keywords(index: DataFrame) -> DataFrame:
    """Of noise keywords, the document whose id equals the keyword goes; others stay."""
    return index.filter(~(is_noise_keyword(F.col("keyword")) & (F.col("doc_id") == F.col("keyword"))))


def _chosen(spans: Column) -> Column:
    """Of spans sorted by start with one (the longest) a start, those a left-to-right sweep takes."""
    kind = "struct<start:int,stop:int,match_key:string>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["end"]
        return F.struct(F.when(free, s["stop"]).otherwise(acc["end"]).alias("end"), F.when(free, F.array_append(acc["out"], s)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step)["out"]


class Trie(NamedTuple):
    """``known`` (known, n_words): the distinct keywords; ``heads`` (head, lengths): a head and the numbers of words of the keywords under it; ``index``: the index itself. Each bears the hint that suits its rows."""

    known: DataFrame
    heads: DataFrame
    index: DataFrame


def _sized(table: DataFrame) -> DataFrame:
    """A written table with the hint that suits its rows: few are broadcast, so that a key which most claims hold needs no shuffle."""
    return table.hint("broadcast" if table.limit(BROADCAST_KEYWORDS + 1).count() <= BROADCAST_KEYWORDS else "merge")


def keyword_trie(index: DataFrame, lower: bool = False) -> Trie:
    """The tables are written and counted: few rows are broadcast, joins with more split a head or keyword that is met in most claims."""
    index = written(index.select("keyword", "doc_id", "priority"), "index")
    keyword = F.lower("keyword") if lower else F.col("keyword")
    words = F.split("known", " ")
    known = written(index.select(keyword.alias("known")).distinct().withColumn("n_words", F.size(words)), "keywords")
    heads = written(known.groupBy(F.array_join(F.slice(words, 1, 2), " ").alias("head")).agg(F.collect_set("n_words").alias("lengths")), "heads")
    return Trie(*map(_sized, (known, heads, index)))


def match_spans(claims: DataFrame, index: DataFrame, keys: list[str], longest: int | None = None, lower: bool = False, trie: Trie | None = None) -> DataFrame:
    """(keys, match_key, start, stop): leftmost-longest non-overlapping keyword matches (of ``longest`` words at most) over tokens.

    Two rows a place are looked up among the heads; what follows grows with the heads found, not with the longest keyword.
    """
    known, heads, _ = trie or keyword_trie(index, lower)
    plain = (lambda c: F.lower(c)) if lower else (lambda c: c)
    places = claims.select(*keys, F.posexplode("tokens").alias("start", "_w"), "tokens")
    first = F.array_join(F.slice("tokens", F.col("start") + 1, 1), " ")
    two = F.array_join(F.slice("tokens", F.col("start") + 1, 2), " ")
    asked = places.select(*keys, "start", F.explode(F.when(F.col("start") + 1 < F.size("tokens"), F.array(plain(first), plain(two))).otherwise(F.array(plain(first)))).alias("head"))
    hits = asked.join(heads, "head").groupBy(*keys).agg(F.collect_list(F.struct("start", "lengths")).alias("hits"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    met = claims.select(*keys, "tokens").alias("c").join(hits.alias("h").hint("merge"), same)
    grams = met.select(*[F.col(f"c.{k}") for k in keys], "tokens", F.inline("hits")).select(*keys, "tokens", "start", F.explode("lengths").alias("n"))
    grams = grams.filter(F.col("start") + F.col("n") <= F.size("tokens")).filter(F.col("n") <= longest if longest else F.lit(True))
    grams = grams.select(*keys, "start", (F.col("start") + F.col("n")).cast("int").alias("stop"), F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " ").alias("match_key"))
    found = grams.join(known, plain(F.col("match_key")) == F.col("known"), "left_semi")
    best = found.groupBy(*keys, "start").agg(F.max(F.struct("stop", "match_key")).alias("m"))
    spans = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("m.stop").alias("stop"), F.col("m.match_key").alias("match_key")))).alias("s"))
    return spans.select(*keys, F.inline(_chosen(F.col("s")))).select(*keys, "match_key", "start", "stop")


def link_keywords(claims: DataFrame, index: DataFrame, keys: list[str] | None = None, longest: int | None = None, lower: bool = False, trie: Trie | None = None) -> DataFrame:
    """Links of the matches' candidates; ``lower`` matches regardless of case. ``trie``: the index's, where it serves several calls."""
    keys = keys or ["claim_id"]
    trie = trie or keyword_trie(index, lower)
    spans = match_spans(claims, index, keys, longest, lower, trie)
    on = (F.lower("match_key") == F.lower("keyword")) if lower else (F.col("match_key") == F.col("keyword"))
    return spans.join(trie.index, on).groupBy(*keys, "match_key", "start", "stop", "doc_id").agg(F.max("priority").alias("priority"))


def _same_letter() -> Column:
    return F.substring("doc_id", 1, 1) == F.substring("match_key", 1, 1)


def _stop_key() -> Column:
    return F.lower("match_key").isin(*C.STOP_WORDS)


def _titled(words: Column, at: int) -> Column:
    return F.transform(words, lambda w, i: F.when(i == at, F.initcap(w)).otherwise(w))


def first_letter_filter(claims: DataFrame, index: DataFrame, max_rounds: int | None = None, trie: Trie | None = None) -> DataFrame:
    """Links whose document starts with the key's first character, without stop-word keys.

    A key of more than two tokens that keeps no candidate is matched again without its first token, the next one in title
    case; fragments shrink, so the rounds are bounded by the longest keyword.
    """
    trie = trie or keyword_trie(index)
    longest = trie.known.agg(F.max("n_words")).first()[0] or 1
    work, out = claims.select("claim_id", F.lit("").alias("part"), "tokens"), None
    for _ in range(max_rounds or longest):
        links = written(link_keywords(work, index, ["claim_id", "part"], trie=trie).filter(~_stop_key()), "links")
        kept = links.filter(_same_letter()).select("claim_id", "match_key", "start", "stop", "doc_id", "priority")
        out = kept if out is None else out.unionByName(kept)
        lost = links.groupBy("claim_id", "part", "match_key").agg(F.max(_same_letter().cast("int")).alias("ok")).filter("ok = 0")
        words = F.split("match_key", " ")
        lost = lost.filter(F.size(words) > 2)
        work = written(lost.select("claim_id", F.concat_ws("/", "part", "match_key").alias("part"), _titled(F.slice(words, 2, F.size(words) - 1), 0).alias("tokens")), "fragments")
        if longest <= 2 or not work.limit(1).count():
            break
    return out.groupBy("claim_id", "match_key", "doc_id").agg(F.max("priority").alias("priority"))


def _swept(tokens: list[str], keys: dict[str, bool]) -> list[tuple[str, int, int]]:
    """(key, start, stop) of the leftmost-longest matches among ``keys`` (key -> whether it fails).

    A failing key loses its first token. The sweep then goes back to the first place whose n-grams can reach over the gap;
    what it took before that place stands.
    """
    tokens, longest = list(tokens), max(key.count(" ") for key in keys) + 1
    taken: list[tuple[str, int, int]] = []
    at = 0
    while at < len(tokens):
        grams = ((" ".join(tokens[at : at + n]), n) for n in range(min(longest, len(tokens) - at), 0, -1))
        key, n = next((g for g in grams if g[0] in keys), (None, 1))
        if key is None:
            at += 1
        elif not keys[key]:
            taken.append((key, at, at + n))
            at += n
        else:
            del tokens[at]
            at = max(0, at - longest + 1)
            while taken and taken[-1][1] >= at:
                taken.pop()
            at = max(at, taken[-1][2] if taken else 0)
    return taken


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["claim_id", "match_key", "start", "stop"]
    for batch in batches:
        for at in range(batch.num_rows):  # a claim at a time: its keywords are lists of their own
            claim = batch.slice(at, 1)
            keys = {k["known"]: k["fails"] for k in claim.column("keys")[0].as_py()}
            taken = _swept(claim.column("tokens")[0].as_py(), keys)
            found = [pa.array([t[i] for t in taken], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([claim.column("claim_id").take(pa.array([0] * len(taken), pa.int32())), *found], names)


def _swept_again(claims: DataFrame, known: DataFrame, failing: DataFrame) -> DataFrame:
    """Spans of claims that meet a failing key, swept with restarts within the claim.

    The gaps that restarts leave make new n-grams, but only of the claim's own words: a claim needs the keywords all of whose
    words it holds. They are found by each keyword's rarest word, so a frequent word gathers only the keywords that have no other.
    """
    words = F.split("known", " ")
    by_word = known.select("known", F.explode(F.array_distinct(words)).alias("word"))
    counts = written(by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    rarest = by_word.join(counts.hint("merge"), "word").groupBy("known").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    marks = failing.select(F.col("match_key").alias("known"), F.lit(True).alias("fails"))
    rated = written(rarest.join(marks.hint("merge"), "known", "left").select("word", "known", F.coalesce("fails", F.lit(False)).alias("fails")), "rarest")
    held = claims.select("claim_id", F.array_distinct("tokens").alias("own")).withColumn("word", F.explode("own"))
    near = held.join(rated.hint("merge"), "word").filter(F.size(F.array_except(words, "own")) == 0)
    keys = near.groupBy("claim_id").agg(F.collect_set(F.struct("known", "fails")).alias("keys"))
    kind = claims.schema["claim_id"].dataType.simpleString()
    return claims.select("claim_id", F.array_compact("tokens").alias("tokens")).join(keys.hint("merge"), "claim_id").select("claim_id", "tokens", "keys").mapInArrow(_sweeps, f"claim_id {kind}, match_key string, start int, stop int")


def _restarting(claims: DataFrame, index: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links kept by ``keep`` (adds a boolean ``ok``). When a key of more than two tokens keeps none, the claim loses that key's first token and is matched anew, matches so far discarded.

    Whether a key fails depends on the index alone, so keys are rated before any claim is read, and claims that meet a failing
    one restart within themselves: the number of Spark jobs doesn't follow the number of restarts.
    """
    trie = keyword_trie(index)
    rated = written(keep(index.select(F.col("keyword").alias("match_key"), "doc_id", "priority")).filter(~_stop_key()).select("match_key", "doc_id", "priority", "ok"), "rated")
    by_key = rated.groupBy("match_key").agg(F.max(F.col("ok").cast("int")).alias("ok"))
    failing = written(by_key.filter((F.col("ok") == 0) & (F.size(F.split("match_key", " ")) > 2)).select("match_key"), "failing")
    failing = _sized(failing)
    spans = written(match_spans(claims, index, ["claim_id"], trie=trie), "spans")
    again = written(spans.join(failing, "match_key", "left_semi").select("claim_id").distinct(), "restarted")
    swept = _swept_again(claims.join(again.hint("merge"), "claim_id", "left_semi"), trie.known, failing)
    spans = spans.join(again.hint("merge"), "claim_id", "left_anti").unionByName(swept)
    links = spans.join(_sized(rated.filter("ok").drop("ok")), "match_key")
    return links.groupBy("claim_id", "match_key", "start", "stop", "doc_id").agg(F.max("priority").alias("priority"))


def link_keywords_multi(claims: DataFrame, index: DataFrame) -> DataFrame:
    return _restarting(claims, index, lambda links: links.withColumn("ok", _same_letter()))


def _with_rarity(links: DataFrame, frequencies: DataFrame, threshold: int) -> DataFrame:
    """``frequent``: all words of the key occur more often than the threshold in the corpus (word, n)."""
    keys = links.select("match_key").distinct()
    words = keys.select("match_key", F.explode(F.split(F.lower("match_key"), " ")).alias("word")).join(frequencies.hint("merge"), "word", "left")
    flags = words.groupBy("match_key").agg(F.bool_and(F.coalesce("n", F.lit(0)) > threshold).alias("frequent"))
    return links.join(flags.hint("merge"), "match_key")


def link_frequency_aware(claims: DataFrame, index: DataFrame, frequencies: DataFrame, threshold: int = 5) -> DataFrame:
    """The first-letter rule only for keys of frequent words; other keys keep all candidates."""
    return _restarting(claims, index, lambda links: _with_rarity(links, frequencies, threshold).withColumn("ok", ~F.col("frequent") | _same_letter()))


def link_no_bracket(claims: DataFrame, index: DataFrame, frequencies: DataFrame, threshold: int = 2) -> DataFrame:
    """As link_frequency_aware, but a rare key in lower case loses candidates with brackets."""
    small = F.col("match_key").rlike("^[a-z]")
    rule = F.when(F.col("frequent"), _same_letter()).when(small, ~F.col("doc_id").contains("-LRB-")).otherwise(True)
    return _restarting(claims, index, lambda links: _with_rarity(links, frequencies, threshold).withColumn("ok", rule))


def word_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over a corpus, words in lower case."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(frequencies: DataFrame, above: int = 10) -> DataFrame:
    return frequencies.filter(F.col("n") > above)


def without_article(claims: DataFrame, articles: tuple[str, ...] = ARTICLES) -> DataFrame:
    """Claims that start with an article: without it, the next token in title case."""
    rows = claims.filter(F.get("tokens", F.lit(0)).isin(*articles) & (F.size("tokens") > 1))
    return rows.withColumn("tokens", _titled(F.slice("tokens", 2, F.size("tokens")), 0))


def article_rule(claims: DataFrame, links: DataFrame, index: DataFrame, multi: bool = False, trie: Trie | None = None) -> DataFrame:
    """Links joined by those of the claim without its article. The multi form knows ``One`` too and drops the article's own key."""
    articles = (*ARTICLES, "One") if multi else ARTICLES
    bare = without_article(claims, articles)
    more = link_keywords_multi(bare, index) if multi else link_keywords(bare, index, trie=trie)
    if multi:
        first = claims.select("claim_id", F.get("tokens", F.lit(0)).alias("match_key")).filter(F.col("match_key").isin(*articles))
        links = links.join(first.hint("merge"), ["claim_id", "match_key"], "left_anti")
    columns = ["claim_id", "match_key", "doc_id", "priority"]
    return links.select(*columns).unionByName(more.select(*columns)).distinct()


def singular(word: Column) -> Column:
    """English singular by suffix rules."""
    out = F.when(word.rlike("(?i)(ss|us|is)$"), word)
    for ending, put in (("(?i)([^aeiou])ies$", "$1y"), ("(?i)(sh|ch|x|ss|z)es$", "$1"), ("(?i)([aeo])ves$", "$1f"), ("(?i)men$", "man"), ("(?i)s$", "")):
        out = out.when(word.rlike(ending), F.regexp_replace(word, ending, put))
    return out.otherwise(word)


def unlinked(claims: DataFrame, links: DataFrame) -> DataFrame:
    return claims.join(links.select("claim_id").distinct().hint("merge"), "claim_id", "left_anti")


def singularize_fallback(claims: DataFrame, links: DataFrame, index: DataFrame, trie: Trie | None = None) -> DataFrame:
    """Links, and for claims without any those of their singularised tokens."""
    links = written(links, "links")
    rest = written(unlinked(claims, links).withColumn("tokens", F.transform("tokens", singular)), "unlinked")
    return links.unionByName(link_keywords(rest, index, trie=trie).select(*links.columns))


def lowercase_fallback(claims: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """Links, and for claims without any those of their tokens without stop words, regardless of case."""
    links = written(links, "links")
    rest = written(unlinked(claims, links).withColumn("tokens", F.filter("tokens", lambda w: ~F.lower(w).isin(*C.STOP_WORDS))), "unlinked")
    return links.unionByName(link_keywords(rest, index, lower=True).select(*links.columns))


def literal_rewrite(claims: DataFrame, rewrites: dict[str, str], column: str = "claim") -> DataFrame:
    text = F.col(column)
    for old, new in rewrites.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return claims.withColumn(column, text)


def docid_rules(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Per candidate: the bracket overlap score at priority 1.0, then the media bonus. Claims have tokens and lemmas (tokens where null)."""
    title = F.transform(C.title_tokens("doc_id"), lambda t: F.when(t.rlike("^-[LR][RSC]B-$"), t).otherwise(F.lower(t)))
    rows = links.join(claims.select("claim_id", F.col("tokens").alias("_t"), F.coalesce("lemmas", "tokens").alias("_l")).hint("merge"), "claim_id").withColumn("_d", title)
    score = F.when(F.col("priority") == STRIPPED, C.bracket_overlap_score("_d", "_d", "_t", "_l")).otherwise(F.col("priority"))
    return rows.withColumn("priority", F.round(score + C.media_bonus("_d"), 6)).drop("_t", "_l", "_d")


def multi_index_link(claims: DataFrame, indexes: list[tuple[DataFrame, float]]) -> DataFrame:
    """Hits of several indexes, each with its own priority, appended."""
    out = None
    for i, (index, priority) in enumerate(indexes):
        hits = link_keywords(claims, index).withColumns({"priority": F.lit(float(priority)), "index_id": F.lit(i)})
        out = hits if out is None else out.unionByName(hits)
    return out


def build_keyword_dict(doc_ids: DataFrame) -> DataFrame:
    """(doc_id, keyword) with the natural title; lemmas and entities are optional inputs joined by the caller."""
    return doc_ids.select(F.col("id").alias("doc_id"), F.array_join(C.title_tokens("id"), " ").alias("keyword"))


Rule = Callable[[DataFrame], DataFrame]


def rule_chain(links: DataFrame, rules: list[Rule]) -> DataFrame:
    """Applies rules in order; a user's rule set is any list of functions of links. What a rule gives is written, since the next may read it several times: a plan holds one rule."""
    for i, rule in enumerate(rules):
        links = rule(links if i == 0 else written(links, "links"))
    return links


def preset(name: str, claims: DataFrame, index: DataFrame, views: DataFrame | None = None, frequencies: DataFrame | None = None) -> list[Rule]:
    """Rule sets by name: default, lower, raw_id, word_freq, pageview, nopageview. The first rule ignores its argument and links the claims."""
    from evidentia.operators.docs import pageview_rank

    index = written(index, "index")
    trie = keyword_trie(index)

    def start(links: DataFrame) -> DataFrame:
        return link_keywords(claims, index, trie=trie).select("claim_id", "match_key", "doc_id", "priority")

    def raw(links: DataFrame) -> DataFrame:
        return first_letter_filter(claims, index, trie=trie)

    def frequency(links: DataFrame) -> DataFrame:
        return link_frequency_aware(claims, index, frequencies).select("claim_id", "match_key", "doc_id", "priority")

    articles: Rule = lambda links: article_rule(claims, links, index, trie=trie)
    singulars: Rule = lambda links: singularize_fallback(claims, links, index, trie)
    lowered: Rule = lambda links: lowercase_fallback(claims, links, index)
    titles: Rule = lambda links: docid_rules(links, claims)
    ranked: Rule = lambda links: pageview_rank(links, views)
    sets = {
        "default": [start, articles, singulars, titles],
        "lower": [start, articles, singulars, lowered, titles],
        "raw_id": [raw, articles, singulars, titles],
        "nopageview": [raw, articles, titles],
        "pageview": [raw, articles, singulars, titles, ranked],
        "word_freq": [frequency, articles, singulars, titles, ranked],
    }
    return sets[name]
