"""Near duplicates against all pairs, and extracted texts against the article elements of the pages."""

import html
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from tidemark.llm import htmltext

SF = Path("/root/testdata/sf0.001")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def one_of_each(texts):
    """The least id of each component of texts of similarity 0.8 or more."""
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    sets = {k: shingles(t) for k, t in texts.items()}
    for k in sorted(sets):
        for s in sets[k]:
            by_shingle[s].append(k)
    shared = Counter((a, b) for ks in by_shingle.values() for i, b in enumerate(ks) for a in ks[:i])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {k for k in texts if root(k) == k}


def test_near_duplicates_match_all_pairs(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet")).filter("trim(text) <> ''")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, str(SF)).select("doc_id").collect()}
    assert kept == one_of_each({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


BLOCK = r"</?(?:article|p|h[1-6]|div|br|li|ul|ol|blockquote|pre|table|tr|td|section)\b[^>]*>"


def article(page):
    inner = re.search(r"(?s)<article\b[^>]*>(.*?)</article>", page).group(1)
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style|aside|form)\b.*?</\1>", "", inner)
    blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(BLOCK, inner)]
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_extracted_texts_are_the_articles(spark):
    pages = spark.read.parquet(str(SF / "pages.parquet"))
    want = {r.page_id: article(r.html) for r in pages.collect() if "<article" in (r.html or "")}
    found = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    wrong = {k for k in want if found[k] != want[k]}
    assert len(want) > 10
    assert not wrong, [(k, want[k][-200:], found[k][-200:]) for k in list(wrong)[:3]]


def test_placing_forgets_the_words():
    from tidemark.llm import packing

    packing.word_level(packing.vocabulary())
    ranges, _ = packing.plan({3: 2})
    assert list(packing.placer(ranges)(iter(()))) == [] and packing.word_level.cache_info().currsize == 0
