"""Whole results of the queries against plain versions written here, over the tables of sf0.01."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import contamination, html, langid, minhash, pii, quality, sentences, sharding, substrings

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_verdicts(spark, docs):
    """Each verdict again, by walking every tree node by node."""
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit(table, labels)

    def score(x):
        total = forest.start
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    rows = quality.query(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        w = words(docs[r["doc_id"]])
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeats = len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})
        failed = len(w) < 50 or 100 * repeats > 50 * len(w)
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(w), repeats, failed)
        assert r["kept"] == (not failed and score(quality.measure(docs[r["doc_id"]])[5]) >= 0.5)


def test_quality_on_held_out_labels(spark, docs):
    """Trees grown from the labels of two thirds of the documents tell the good of the rest."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None and r["doc_id"] in docs}
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 0
    x = {d: quality.measure(docs[d])[5] for d in labels}
    train = [d for d in sorted(labels) if not held(d)]
    forest = quality.grow(np.array([x[d] for d in train]), np.array([float(labels[d]) for d in train]))
    test = [d for d in sorted(labels) if held(d)]
    right = np.mean([(p >= 0.5) == bool(labels[d]) for d, p in zip(test, forest.probability(np.array([x[d] for d in test])), strict=True)])
    assert len(test) > 50 and right >= 0.85, (len(test), right)


class Article(HTMLParser):
    """The article's blocks, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.inside, self.off = [], [], False, 0

    def end_block(self):
        self.blocks.append(" ".join("".join(self.now).split()))
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "h2", "h3", "li", "div", "ul", "article"):
            self.end_block()
        if tag == "br":
            self.now.append(" ")
        if tag in ("script", "style") or tag == "div" and "ad" in dict(attrs).get("class", "").split():
            self.off += 1

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "li", "div", "ul", "article"):
            self.end_block()
        if tag == "article":
            self.inside = False
        if tag in ("script", "style") or tag == "div" and self.off:
            self.off -= 1

    def handle_data(self, data):
        if self.inside and not self.off:
            self.now.append(data)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    got = {r["page_id"]: r for r in html.query(spark, SF).collect()}
    assert set(got) == set(pages)
    for p, source in pages.items():
        reader = Article()
        reader.feed(source or "")
        reader.close()
        reader.end_block()
        want = "\n".join(b for b in reader.blocks if b)
        assert got[p]["text"] == want, p
        assert got[p]["n_chars"] == len(want)
    assert entities.unescape("&amp;") == "&"


def test_mixed_languages(spark):
    """Spans of texts that are put together from documents of several languages."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["lang"] and r["lang"] != "und" and r["text"] and len(r["text"].split()) > 60]
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    table = spark.createDataFrame([(r["text"], r["lang"], r["doc_id"] * 7919) for r in rows if r not in held], "text string, lang string, __h long")
    model = langid.fit(table)
    parts = defaultdict(list)
    for r in held:
        parts[r["lang"]].append(" ".join(r["text"].split()[:50]))
    right = total = cuts = mixed = 0
    for k in range(20):
        langs = [x for x in sorted(parts) if len(parts[x]) > k][: 2 + k % 2]
        texts = [parts[x][k] for x in langs]
        truth = [x for x, t in zip(langs, texts, strict=True) for _ in range(len(model.words(t)[1]))]
        found = langid.spans(model, " ".join(texts))
        assert [a for a, _, _ in found[1:]] == [b for _, b, _ in found[:-1]] and found[-1][1] == len(truth)
        got = [x for a, b, x in found for _ in range(a, b)]
        right, total, cuts, mixed = right + sum(x == y for x, y in zip(got, truth, strict=True)), total + len(truth), cuts + len(found), mixed + len(langs)
    assert right >= 0.95 * total and cuts <= 1.5 * mixed, (right, total, cuts, mixed)
    assert langid.spans(model, "") == langid.spans(model, None) == langid.spans(model, "12 34") == []


def test_personal_data_bases(spark, docs):
    from tests.llm.test_llm import base_spans

    for r in pii.query(spark, SF).collect():
        want = base_spans(docs[r["doc_id"]] or "")
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_substrings(spark, docs):
    data = {d: (t or "").encode() for d, t in docs.items()}
    seen = Counter(hash(b[i : i + 400]) for b in data.values() for i in range(len(b) - 399))
    for r in substrings.query(spark, SF).collect():
        b = data[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["n_kept"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, len(kept), hashlib.sha256(kept).hexdigest())
        assert r["text"] == kept.decode("utf-8", "replace")


def test_repeated_passages(spark, docs):
    """Documents with 51 words of an earlier document in a row lose sentences; those without 20 such words, and that don't
    repeat themselves, lose nothing."""
    left = {r["doc_id"]: r["n_removed"] for r in sentences.query(spark, SF).collect()}
    hits = clean = found = kept = 0
    seen = {20: {}, 51: {}}
    for d in sorted(docs):
        w = words(docs[d])
        shares = {}
        for n in seen:
            grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
            shares[n] = any(seen[n].get(g, d) != d for g in grams), len(set(grams)) < len(grams)
            for g in grams:
                seen[n].setdefault(g, d)
        if shares[51][0]:
            hits, found = hits + 1, found + (left[d] > 0)
        elif not any(shares[20]):
            clean, kept = clean + 1, kept + (left[d] == 0)
    assert hits > 50 and found >= 0.95 * hits, (hits, found)
    assert clean > 500 and kept >= 0.99 * clean, (clean, kept)


def test_near_duplicates(spark, docs):
    """All components again, from every pair of texts that share a shingle."""
    sets = {}
    for d, t in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    members = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            members[g].append(d)
    shared = Counter((a, b) for m in members.values() if len(m) < 200 for i, a in enumerate(m) for b in m[:i])
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), _ in shared.items():
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    for r in minhash.query(spark, SF).collect():
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), top(d), top(d) == d)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_shards(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = sharding.query(spark, sf).collect()
    assert len(rows) == len(texts)
    size, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes"
        size[r["shard"]] += r["size"]
        where[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    fair = sum(size.values()) / 16
    copies = Counter(texts.values())
    torn = [t for t, s in where.items() if len(s) > 1 and copies[t] * (len(t.encode()) + 1) <= fair]
    assert not torn and set(size) == set(range(16)) and max(size.values()) <= 1.01 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_contamination_misses_nothing(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = {i: grams(t) for i, t in items.items()}
    want = set()
    for d, t in docs.items():
        g = grams(t)
        want |= {(d, i, len(g & s), len(s)) for i, s in own.items() if s and 100 * len(g & s) >= 80 * len(s)}
    assert {tuple(r) for r in contamination.query(spark, SF).select("doc_id", "item_id", "n_shared", "n_item").collect()} == want and want
