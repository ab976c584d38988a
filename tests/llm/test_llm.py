"""The corpus operators on small tables: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import contamination, html, induced, langid, minhash, packing, pii, quality, sentences, sharding, substrings

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, ids=None):
    return table(spark, [(i, t, "en", "s", 0, 0.0, 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)])


def odd(spark):
    long = "word " * 60_000 + "+1 (555) 555-0100 a@b.example.com."
    return docs_of(spark, [None, "", "   ", "x", long, long, "4" * 5000, "same text here. " * 40], [0, 1, None, 3, 4, 4, 6, 7])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", " ", "a b c "]) for _ in range(rng.randint(0, 60)))
        w = words(text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert quality.measure(text)[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(3000) < 0.6).astype(float)
    forest = quality.grow(x, y)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    more = x.copy()
    more[:, [2, 3, 4]] += rng.random((3000, 3))
    assert (forest.margin(more) <= forest.margin(x) + 1e-9).all()


def test_quality_query(spark):
    got = {r["doc_id"]: r for r in quality.query(spark, SF).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    good = [d for d, q in labels if q == 1 and not got[d]["base_failed"]]
    assert sum(got[d]["kept"] for d in good) >= 0.9 * len(good)


@pytest.mark.parametrize(("good", "bad"), [(1, 1), (30, 30), (30, 0)])
def test_trees_grow_from_few_labels(spark, good, bad):
    docs = docs_of(spark, [f"plain words {i} of a text. " * 9 for i in range(good)] + [f"#$% |{i}| <> *** " * 9 for i in range(bad)])
    labels = docs.selectExpr("doc_id", f"cast(doc_id < {good} AS int) AS quality")
    forest = quality.fit(docs, labels)
    assert (forest is not None) == (bad > 0)
    if good > 20 and bad:  # leaves of at least 20 rows
        got = [r["score"] >= 0.5 for r in quality.verdicts(docs, forest).orderBy("doc_id").collect()]
        assert got == [True] * good + [False] * bad
    assert quality.fit(docs, labels.limit(0)) is None


def test_trees_of_repeated_ids_are_bounded(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "grow", lambda x, y: sizes.append(len(y)))
    docs = docs_of(spark, [f"text {i} " * i for i in range(30)], [i % 2 for i in range(30)])
    quality.fit(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int"), limit=10)
    assert sizes == [10]


def test_quality_query_larger(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.query(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good = [d for d, q in labels if q == 1 and not got[d]["base_failed"]]
    assert sum(got[d]["kept"] for d in good) >= 0.9 * len(good)
    assert any(not r["kept"] and not r["base_failed"] for r in got.values())


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: quality.verdicts(d, None), lambda d: quality.keep_good(d, None), packing.pack, sharding.shard, sentences.remove_repeats, substrings.dedup, minhash.groups, minhash.one_of_each, pii.detect, pii.mask,
        lambda d: contamination.search(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: contamination.clean(d, d.selectExpr("doc_id AS item_id", "text").limit(0)),
        lambda d: langid.label(d.selectExpr("doc_id", "false AS held_out", "text"), langid.fit(d.selectExpr("text", "lang", "xxhash64(doc_id) AS __h"))),
        lambda d: html.extract(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "rid")),
    ],
)
def test_odd_and_empty_tables(spark, apply):
    assert apply(odd(spark).limit(0)).count() == 0
    out = apply(odd(spark))
    rows = out.collect()
    if {"doc_id", "kept"} <= set(out.columns) or "n_removed" in out.columns or "size" in out.columns:
        assert len(rows) == 8


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(docs_of(spark, [None, "a  b\n c", "d\n", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endoftext", "<|endoftext|>"], range(900, 906)).select("doc_id", "text", "lang", "source", "n_chars"))
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(own) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_language_accuracy(spark):
    got = {r["doc_id"]: r for r in langid.query(spark, "/root/testdata/sf0.01").collect()}
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == r["held_out"] for d, r in got.items())
    assert sum(got[d]["lang_pred"] == true[d] for d in held) >= 0.95 * len(held)


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        score = rng.normal(size=(6, 3)) * 3
        value = lambda p: sum(score[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(value([c // 3**i % 3 for i in range(6)]) for c in range(729))
        assert value(langid.viterbi(score, 2).tolist()) == pytest.approx(best)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if ok(k, m.group()))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def test_personal_data(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a@b.c", "x_y@d.e.f_g@h.i", "1.2.3.4", ".256", "4111 1111-1111 1111", "+1 (555) 555-0100", " ", "é", "😀", "+", "12", "@", ".", "z"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.detect(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_added_spans(spark):
    """Planted: true candidates that no base pattern has, and look-alikes of other meaning."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    true, texts = [], []
    for i in range(600):
        kind = i % 6
        if kind < 3:
            span = [f"({digits(3)}) {digits(3)}-{digits(4)}", f"{name()} (at) {name()} (dot) com", f"{name()}[at]{name()}.org"][kind]
            head = ["Please call me: ", "Write a mail to ", "Contact me at: "][kind]
        else:
            span = [f"{digits(3)}-{digits(3)}-{digits(4)}", f"{name()}[at]{name()}", f"{name()}{{at}}x"][kind - 3]
            head = ["isbn 9", "the version v", "order a/"][kind - 3]
        texts.append(f"{name()} {name()}. {head}{span}{'.' if kind < 3 else '/x'} {name()}")
        true.append({(len(f"{texts[-1].split(head)[0]}{head}"), len(f"{texts[-1].split(head)[0]}{head}{span}"))} if kind < 3 else set())
    got = {r["doc_id"]: {tuple(map(int, x.split(":")[1:])) for x in filter(None, r["spans"].split(","))} for r in pii.detect(docs_of(spark, texts)).collect()}
    found, wanted = sum(len(got[i]) for i in range(600)), sum(map(len, true))
    right = sum(len(got[i] & true[i]) for i in range(600))
    assert right >= 0.9 * wanted and right >= 0.9 * found, (right, wanted, found)


def test_masking(spark):
    out = pii.mask(docs_of(spark, ["mail a@b.org now", "none", None])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["mail [EMAIL] now", "none", None]
    assert out[0]["n_chars"] == len(out[0]["text"])


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(100):
        t = [rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 50))]
        assert induced.suffix_array(np.array(t), 10**6).tolist() == sorted(range(len(t) + 1), key=lambda i: [*t, 0][i:])


def test_windows_by_hash():
    rng = random.Random(2)
    for _ in range(50):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 40))) for _ in range(rng.randint(1, 6))]
        starts = [rng.randint(0, len(p) - 5) for p in parts]
        a, b = (f(parts, starts, 6) for f in (induced.repeated, induced.repeated_by_hash))
        assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_queue_spills():
    q = induced.RunQueue(3, budget=10)
    for k in range(20):
        q.push(k % 3, np.arange(k, k + 4))
    assert q.pop(1).tolist() == [x for k in range(1, 20, 3) for x in range(k, k + 4)]
    q.close()


def removed_by_force(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append((int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_substrings(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    shared = [text(700) for _ in range(3)]
    texts = [None, "", "ab" * 900, "x" * 500, text(399), *(text(rng.randint(0, 300)) + rng.choice(shared)[rng.randint(0, 200) :] + text(50) for _ in range(25))]
    for _ in range(60):  # a crowd of near copies
        i = rng.randint(0, 690)
        texts.append(shared[0][:i] + "Z" + shared[0][i + 1 :])
    want = removed_by_force(texts)
    for crowd in (48, 2):
        monkeypatch.setattr(substrings, "CROWD", crowd)
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs_of(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def groups_by_force(texts, n, percent):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []) for w in (words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize(("n", "share", "long"), [(3, 0.85, 32), (5, 0.8, 32), (3, 0.85, 3)])
def test_near_duplicates(spark, monkeypatch, n, share, long):
    monkeypatch.setattr(minhash, "LONG", long)
    rng = random.Random(7)
    base = [[f"W{rng.randint(0, 400)}" for _ in range(rng.randint(4, 200))] for _ in range(8)]
    texts = [None, "", "a", "A", "a b"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 30)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in minhash.groups(docs_of(spark, texts), n, share).collect()}
    roots, sizes = groups_by_force(texts, n, round(100 * share))
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, own, other = ("".join(f"{k}{i} " for i in range(40)) for k in ("a", "b", "c", "d", "own", "other"))
    # a: null id beside an id; b: null ids only; c: one id repeated; d: equal rows beside a greater id; 7 with two texts
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, c), (3, d), (3, d), (4, d), (None, own), (7, other), (7, a), (None, None), (None, "")]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    want = Counter([(1, a), (None, b), (2, c), (3, d), (None, own), (7, other), (None, None), (None, "")])
    assert Counter((r["doc_id"], r["text"]) for r in minhash.one_of_each(docs).collect()) == want
    assert sum(r["kept"] for r in minhash.groups(docs).collect()) == len(want)
    items = spark.createDataFrame([(5, own), (6, other)], "item_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in contamination.clean(docs, items).collect())
    assert got == Counter(rows) - Counter([(None, own), (7, other)])


@pytest.mark.parametrize("apply", [minhash.one_of_each, pii.mask, lambda d: contamination.clean(d, d.selectExpr("doc_id AS item_id", "text").limit(1))])
def test_clashing_names(spark, apply):
    docs = docs_of(spark, ["a b c d e f g h", "mail a@b.org now"] * 2)
    for name in ("__held", "__gone", "__spans", "__doc", "__id", "held_id", "held_text", "gone_id", "gone_text", "gone_one", "gone_row", "found_spans", "item_id", "c", "n", "value", "row", "h"):
        docs = docs.selectExpr("*", f"doc_id AS {name}")
    out = apply(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_a_class_has_one_text(spark):
    docs = docs_of(spark, ["one two three four five six"] * 200, [None] * 100 + [7] * 100)
    members = minhash._members(docs, 3)
    wanted = members.select("c").distinct()
    assert minhash._texts(docs, members.drop("values"), wanted, 3).count() == 1
    rows = minhash.groups(docs).collect()
    assert len(rows) == 200 and sum(r["kept"] for r in rows) == 1 and {r["component_id"] for r in rows} == {7}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["c"]: r["root"] for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_html():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four</p><div class='ad'>buy</div><ul><li>x<li>y</ul><script>'</p>'</script><!-- c --></article><div id=comments>hi</div><footer>f</footer></body></html>"
    assert html.main_text(page) == "A & B\none two three\nfour\nx\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a") == ""
    assert html.main_text("a < b") == "a < b"


def test_html_templates(spark):
    rows = [(i, "http://h/x", f"<body><div class='top'>Site words</div><p>Own {i}</p><div>Other {i % 3 and i}</div></body>", 1) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, rid long")).collect()}
    assert all("Site words" not in t and f"Own {i}" in t for i, t in got.items())


def test_subtrees_are_told_by_their_structure():
    tree = lambda s: {h for h, _, _ in html.read(f"<body>{s}</body>")[1]}
    flat, nested = "<div class=x><div>a b</div></div>", "<div class=x><div>a</div><div>b</div></div>"
    assert tree(flat) == tree(flat.replace(" b", "\n b")) and len(tree(flat)) == 2
    assert not tree(flat) & tree(nested) and not tree(flat) & tree(flat.replace("class=x", "class=y")) - tree("<div>a b</div>")
    assert tree("<div>a b</div>") < tree(flat)


def test_html_of_odd_rows(spark):
    top = "<body><div class='top'>Site words</div><p>{}</p></body>"
    rows = [(1, "http://h/1", top.format("same"), 5)] * 30 + [(2, None, top.format("no host"), 6), (None, "", None, 7), (4, "::", "", 8)]
    got = Counter((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, rid long")).collect())
    # thirty equal rows are one page: no template
    assert got == Counter({(1, "Site words\nsame"): 30, (2, "Site words\nno host"): 1, (None, ""): 1, (4, ""): 1})


def test_sharding(spark):
    texts = [f"text {i % 40} " * (i % 90) for i in range(2000)]
    rows = sharding.shard(docs_of(spark, texts)).collect()
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(sizes) == set(range(16))
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_copies_stay_on_one_shard(spark):
    texts = [f"copy {i % 20} " * 30 for i in range(400)] + [f"text {i}" for i in range(3000)] + ["one " * 400] * 60
    got, rows = defaultdict(set), defaultdict(int)
    for r in sharding.shard(docs_of(spark, texts)).collect():
        got[texts[r["doc_id"]]].add(r["shard"])
        rows[r["shard"]] += r["size"]
    large = "one " * 400
    assert len(large) * 60 > sum(rows.values()) / 16  # more than a shard
    assert len(got.pop(large)) > 1 and all(len(x) == 1 for x in got.values())


def test_sketches_find_the_candidates(spark):
    rng = random.Random(11)
    items = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(n)) for n in (3, 5, 12, 40, 90)]
    texts = [None, *(f"before {x} after" for x in items)]
    for x in items:
        w = x.split()
        texts += [" ".join(w[: len(w) * k // 10]) for k in range(1, 10)]
    table_of = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, index = docs_of(spark, texts), contamination.item_shingles(table_of)
    near = {(r["doc_id"], r["item_id"]) for r in contamination.candidates(docs, index).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(t) for t in [*texts, *items])]
    want = {(d, i, len(sets[d] & s), len(s)) for i, s in enumerate(sets[len(texts) :]) for d in range(len(texts)) if 100 * len(sets[d] & s) >= 80 * len(s)}
    shares = {(d, i) for i, s in enumerate(sets[len(texts) :]) for d in range(len(texts)) if sets[d] & s}
    assert {(d, i) for d, i, *_ in want} <= near < shares
    assert {tuple(r) for r in contamination.search(docs, table_of).collect()} == want


def test_passages_of_many_shapes_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    said = lambda n: " ".join(word() for _ in range(n))
    passages = [said(60) + ".", said(30) + ". " + said(30) + ".", " ".join(said(3) + "." for _ in range(18)), said(70), "\n".join(said(7) for _ in range(8)) + "\n"]
    texts = []
    for p in passages:
        texts += [f"{said(40)}. {p} {said(20)}.", f"{said(25)}.\n{p}\n{said(12)}.", p]
    clean = [f"{said(80)}. {said(9)}! {' '.join(said(4) + '.' for _ in range(9))}" for _ in range(20)] + [None, "", "one two. " * 4]
    got = {r["doc_id"]: r for r in sentences.remove_repeats(docs_of(spark, texts + clean)).collect()}
    for i, p in enumerate(passages):
        assert got[3 * i]["n_removed"] == 0 and got[3 * i]["text"] == texts[3 * i]  # the first of its kind
        for k in (1, 2):
            left = got[3 * i + k]["text"].split()
            assert sum(w in left for w in p.split()) < 30, (i, k)
            assert all(w in left for w in texts[3 * i + k].replace(p, " ").split())
    assert all(got[len(texts) + i]["text"] == (t or "") for i, t in enumerate(clean))


def test_sentences_are_the_whole_text():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "bc", ". ", "!?", "\n", "  ", "\t", "é ", "d "]) for _ in range(rng.randint(0, 200)))
        found = sentences.SENTENCE.findall(text)
        assert "".join(found) == text and all(len(s.split()) <= sentences.WORDS + 1 for s in found)


@pytest.mark.parametrize("module", [sentences, contamination])
def test_sql(spark, module):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = module.query(spark, SF), c.sql(module.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[x] for x in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in kept}
    order = sorted(texts)
    roots, _ = groups_by_force([texts[d] for d in order], 5, 80)
    stays = {order[r] for r in roots}
    left = docs.where(docs["doc_id"].isin(list(stays)))
    held = {r["doc_id"] for r in contamination.search(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in rows} == stays - held


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Each stage alone: nulls in any column, empty and long texts, equal rows, no rows, and more columns."""
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(240)) + "."
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, 1), (2, good, "en", "s", len(good), 1.0, 1), (2, good, "en", "s", len(good), 1.0, 1), (None, good + " more", None, None, None, None, None), (3, "mail a@b.org " + "x " * 30_000, "en", "s", 1, 0.5, 2)]
    table(spark, [(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table(spark, [(7, "an item that no text here holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, rows)
    want = {"quality rules": 3, "near-duplicates": 4, "decontamination": 6, "personal data": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.agg({"length": "sum"}).collect()[0][0] == sum(r["doc_tokens"] for r in out.where("start = 0").collect())
        else:
            assert out.columns == docs.columns and out.count() == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs.where("doc_id = 3"), str(tmp_path)).collect()}
    assert masked[3].startswith("mail [EMAIL] x")
