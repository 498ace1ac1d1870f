"""Rule sets over two lists: the documents that a claim's words link to, and, aside, those that its selected sentences link to.

A rule takes a state (claims, tables, main list, link targets of selected sentences, aside list) and returns a new one, so that rules of either hop are
composed in any order: both hops in one go (spiral), the first only, or the second only, once sentences have been scored.
``follow`` goes on from there: hop by hop, from the documents found last to their sentences and the documents these link to, without what was visited.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import docs as D
from evidentia.operators import linking as K
from evidentia.plans.scratch import written

LINK = ("claim_id", "match_key", "doc_id", "priority")


@dataclass(frozen=True)
class Hops:
    """``selected``: scored sentences (claim_id, doc_id, line_num, score); ``link_rows``: (doc_id, line_num, target). ``links`` and ``aside`` are filled by rules; ``trie`` is the index's, made by ``exact_match``."""

    claims: DataFrame | None = None
    index: DataFrame | None = None
    views: DataFrame | None = None
    selected: DataFrame | None = None
    link_rows: DataFrame | None = None
    encode: bool = True
    links: DataFrame | None = None
    targets: DataFrame | None = None
    aside: DataFrame | None = None
    trie: K.Trie | None = None


Rule = Callable[[Hops], Hops]


def exact_match(h: Hops) -> Hops:
    """Also writes the index and makes its trie, which later rules use."""
    index = written(h.index, "index")
    h = replace(h, index=index, trie=K.keyword_trie(index))
    return replace(h, links=K.link_keywords(h.claims, h.index, trie=h.trie).select(*LINK))


def title_scores(h: Hops) -> Hops:
    return replace(h, links=K.docid_rules(h.links, h.claims).select(*LINK))


def singulars(h: Hops) -> Hops:
    return replace(h, links=K.singularize_fallback(h.claims, h.links, h.index, h.trie))


def articles(h: Hops) -> Hops:
    """Adds what the claim without its article links to, where the list hasn't that document under that key."""
    more = K.link_keywords(K.without_article(h.claims), h.index, trie=h.trie).select(*LINK)
    fresh = more.join(h.links.select(*LINK[:3]).hint("merge"), list(LINK[:3]), "left_anti").select(*LINK)
    return replace(h, links=h.links.select(*LINK).unionByName(fresh))


def by_views(h: Hops) -> Hops:
    return replace(h, links=D.pageview_rank(h.links, h.views).select(*LINK))


def from_sentences(h: Hops) -> Hops:
    return replace(h, targets=D.expand_from_sentences(h.selected, h.link_rows, encode=h.encode))


def from_best_sentences(h: Hops) -> Hops:
    """As from_sentences, of each claim's best sentence with links only, chosen before links are joined: a claim's other sentences have no say in the aside list."""
    best = D.best_linked_sentences(h.selected, h.link_rows)
    return replace(h, targets=D.expand_from_sentences(best, h.link_rows, encode=h.encode))


def best_aside(h: Hops) -> Hops:
    return replace(h, aside=D.sentence_links_as_candidates(D.best_sentence_links(h.targets)))


def aside_by_views(h: Hops) -> Hops:
    return replace(h, aside=D.pageview_rank(h.aside, h.views).select(*LINK))


PRESETS: dict[str, list[Rule]] = {
    "spiral": [exact_match, title_scores, singulars, articles, from_best_sentences, best_aside, by_views, aside_by_views],
    "first_hop": [exact_match, title_scores, singulars, articles, by_views],
    "first_hop_no_views": [exact_match, title_scores, singulars, articles],
    "second_hop": [from_best_sentences, best_aside, aside_by_views],
}


def run_rules(state: Hops, rules: list[Rule] | str) -> Hops:
    """The state after a preset, by name, or any list of rules, in order. Lists that a rule made are written before the next rule, which may read them several times."""
    rules = PRESETS[rules] if isinstance(rules, str) else rules
    for i, rule in enumerate(rules):
        made = rule(state)
        if i + 1 < len(rules):
            made = replace(made, **{k: written(getattr(made, k), k) for k in ("links", "targets", "aside") if getattr(made, k) is not None and getattr(made, k) is not getattr(state, k)})
        state = made
    return state


def follow(state: Hops, choose: Callable[[DataFrame], DataFrame], hops: int = 2, k: int = 5) -> DataFrame:
    """(claim_id, doc_id, priority, rank, hop): the k best new documents of each hop, from the state's selected sentences on (hop 2: the main list is hop 1).

    ``choose`` gives the scored sentences (claim_id, doc_id, line_num, score) of a hop's documents; those of each claim's best one lead to the next hop. A claim's visited
    documents (its main list and all hops so far) don't come again, so cycles of links end. Each hop is written; the walk ends after ``hops`` hops or
    when no claim has a new document.
    """
    visited = written(state.links.select("claim_id", "doc_id").distinct(), "visited") if state.links is not None else None
    out, selected = None, state.selected
    for hop in range(2, hops + 2):
        aside = run_rules(replace(state, selected=selected), "second_hop").aside
        fresh = aside if visited is None else D.new_docs_only(aside, visited)
        found = written(D.topk_docs(fresh, k).withColumn("hop", F.lit(hop)), "hop")
        if not found.limit(1).count():
            break
        out = found if out is None else out.unionByName(found)
        more = found.select("claim_id", "doc_id")
        visited = written(more if visited is None else visited.unionByName(more), "visited")
        if hop < hops + 1:
            selected = written(choose(found), "selected")
    return found if out is None else out
