"""Each query on a small table against brute force, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkloom.llm import chat, fingerprint, licenses, minhash, mixing, pieces, pii, queries, topk, toxicity, urlfilter

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
#: Rows beyond those of the table: nulls, empty and very short texts, repeated rows, signs of all kinds.
ODD = [None, "", " ", "a", "A b", "x y z", "x y z", "é\u2028ü  \t\n two", "mail a.b@c-d.e.f, x@y +1 (234) 567-8901, 10.0.0.300 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "MIT  License; the apache-license mit license GNU General Public License", "word " * 3000, "1234567890" * 50, "\x00\x0b▁ <|im_end|> \\ 😀😀", " ".join(f"{w} {i}" if i % 9 == 8 else w for i, w in enumerate(licenses.NOTICES["gpl"][0].split())) + " " + licenses.NOTICES["cc"][0], "permission is hereby granted free " * 40]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    rows += [(1000 + i, t, None if i % 2 else "src0") for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()


def test_pii(docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in pii.found(df).collect()}
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    for doc_id, text, _ in rows:
        base = sorted(((m.start(), list(plain).index(k), k, m.end()) for k, p in plain.items() for m in p.finditer(text or "") if holds(k, m[0])))
        assert got[doc_id]["base_sha256"] == SHA(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
        counts = Counter(k for _, _, k, _ in base)
        assert [got[doc_id][f"n_{k}"] for k in plain] == [counts[k] for k in plain]
        spans = got[doc_id]["spans"].split(",") if got[doc_id]["spans"] else []
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(spans)
    assert pii.redact("ab 1.2.3.4 c", pii.base_spans("ab 1.2.3.4 c")) == "ab <IP> c"


def test_free_places():
    draw = np.random.default_rng(2)
    spans = sorted((("ip", int(a), int(a + n)) for a, n in zip(draw.integers(0, 300, 30), draw.integers(1, 40, 30), strict=True)), key=lambda s: s[1])
    for some in (spans, spans[:1], []):
        free = pii._free(some)
        for a in range(0, 340, 3):
            for b in (a + 1, a + 7, a + 60):
                assert free(a, b) == (not any(s < b and a < e for _, s, e in some))


def test_pii_field_finds_other_forms():
    field = pii.fitted()
    for text, kind in (("please call 555-123-4567 today", "phone"), ("phone (555) 123-4567 now", "phone"), ("write john at example dot com soon", "email"), ("visa 4111.1111.1111.1111 ok", "card")):
        assert [s[0] for s in pii.all_spans(text, field)[1]] == [kind], text
    for text in ("on 2024-01-02 we met", "version 1.22.3 of it", "look at this.", "order 12345 67890 came"):
        assert not pii.all_spans(text, field)[1], text


def test_pii_labelled():
    """Stretches drawn with other seeds than those learnt from, alone and inside prose that looks alike."""
    field, found, right, wanted = pii.fitted(), 0, 0, 0
    prose = "She met him at home. The situation. Then we left early at noon. Bring creation. Next, late. That was at work. Come soon. "
    for seed in (21, 22):
        for i, (text, gold) in enumerate(pii.stretches(400, seed)):
            before = prose if i % 2 else ""
            base, every = pii.all_spans(before + text + (" " + prose if i % 3 else ""), field)
            if base:
                continue
            gold = {(k, a + len(before), b + len(before)) for k, a, b in gold}
            found, right, wanted = found + len(every), right + len(gold & set(every)), wanted + len(gold)
    assert wanted > 300 and right / found >= 0.95 and right / wanted >= 0.95
    assert not pii.all_spans(prose, field)[1]


def test_pii_lattice_is_the_best_segmentation():
    """The dynamic programming against all sets of candidates that don't meet, digits and addresses together."""
    field = pii.fitted()
    for text in ("call 555-123-4567 12 at example dot com 10 20", "ann 12 34 at 12-34-56 dot com 4111.1111.1111.1111 99", "a dot b at c99 dot org 555 123 4567"):
        spans = [s for group in pii.lattices(text) for s in group]
        scores = [field.judged(text, a, b, pii._hint(text, a)) for a, b in spans]
        good = [(s, k, x) for s, (k, x) in zip(spans, scores, strict=True) if x > 0]
        best = 0.0
        for n in range(1 << len(good)):
            some = sorted(good[i] for i in range(len(good)) if n >> i & 1)
            if all(x[0][1] <= y[0][0] for x, y in zip(some, some[1:], strict=False)):
                best = max(best, sum(x for _, _, x in some))
        chosen = [s for group in pii.lattices(text) for s in field.best(text, group)]
        assert sum(field.judged(text, a, b, pii._hint(text, a))[1] for _, a, b in chosen) == pytest.approx(best)


def test_pii_spelt_addresses():
    """Signs of any case and in any brackets; the field chooses where a domain ends, and hides no address behind another."""
    field = pii.fitted()
    for form in ("JOHN AT EXAMPLE DOT COM", "John[AT]example[DOT]com", "john{at}example{dot}com", "john <at> example <dot> com", "john@example dot com", "john (@) example . com", "mary at sales dot example dot org"):
        assert pii.all_spans(form, field)[1] == [("email", 0, len(form))], form
    text = "john at example dot com. dan at other dot org"
    assert [text[a:b] for _, a, b in pii.all_spans(text, field)[1]] == ["john at example dot com", "dan at other dot org"]
    for text in ("we said that is. The end", "look at this.net soon", "a matter of data. Then"):
        assert not pii.all_spans(text, field)[1], text


def shingles(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, k, percent):
    rows, df = docs
    sets = {d: shingles(t, k) for d, t, _ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for r in minhash.near_duplicates(df, k, percent / 100).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])


def components_of(sets, percent):
    """The smallest id that each id reaches by links of any of its sets; sets: (id, set)."""
    label = {d: d for d, _ in sets}
    linked = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if a == b or (s & t and 100 * len(s & t) >= percent * len(s | t))]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def drifting(n, words, changes):
    """Texts of which some are near the first, some near each other only."""
    own, out = [f"w{i}" for i in range(words)], []
    for i in range(n):
        text = list(own)
        for j in range(changes(i)):
            text[(i * 37 + j * 29) % words] = f"x{i % 5}-{j}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("need_bits", [1 << 26, 0])
@pytest.mark.parametrize("changes", [lambda i: i % 8, lambda i: i % 3 * 5, lambda i: 4 + i % 5])
def test_minhash_blocks(monkeypatch, spark, need_bits, changes):
    """A group of near copies larger than a block meets its pivot first, then in blocks; with a bitmap and without."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(minhash, "NEED_BITS", need_bits)
    rows = drifting(40, 200, changes)
    want = components_of([(d, shingles(t, 3)) for d, t in rows], 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == want


def test_minhash_repeated_ids(monkeypatch, spark):
    """Links hold for an id: its texts are of one component; rows without an id join those with the same shingles."""
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "ACD"}
    rows = [(5, text["A"]), (7, text["A"]), (7, text["C"]), (9, text["C"]), (9, text["C"]), (None, text["C"]), (None, text["D"]), (None, text["D"]), (7, None), (3, " ")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect())
    assert got == Counter({(5, 5, True): 1, (7, 5, False): 2, (9, 5, False): 2, (None, 5, False): 1, (None, None, True): 2, (7, 7, True): 1, (3, 3, True): 1})
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    rows = drifting(40, 200, lambda i: i % 7 * 3)
    rows = [(i % 13, t) for i, t in rows] + rows[5:9] * 3
    want = components_of([(d, shingles(t, 3)) for d, t in rows], 85)
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == set(want.items())


def test_minhash_chain_of_revisions(spark):
    """200 revisions, each linked with its neighbours only, their ids in no order."""
    words, rows = [f"w{i}" for i in range(120)], []
    for i, d in enumerate(np.random.default_rng(9).permutation(200) + 1):
        words[i * 7 % 120] = f"r{i}"
        words[(i * 7 + 3) % 120] = f"s{i}"
        rows.append((int(d), " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_recall(spark, k, percent):
    """Every link between different texts of sf0.01 is found: components are those of all pairs with common shingles."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    sets = {d: shingles(t, k) for d, t in rows}
    held, both = {}, Counter()
    for d, s in sorted(sets.items()):
        for x in s:
            for other in held.setdefault(x, []):
                both[other, d] += 1
            held[x].append(d)
    edges = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    label = dict.fromkeys(sets)
    for d in label:
        label[d] = d
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent / 100).collect()}
    assert got == label and sum(sets[a] != sets[b] for a, b in edges) > 5


def listed(spark, names):
    return spark.createDataFrame([(d,) for d in names], "domain string")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "x://b.com/de/", "x://com/fr/a", "x://spam-farm.example.org", "x://m.casino-win.example.net/a#b", "x://other.net", "x://notcom/de/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(df, listed(spark, queries.LISTED)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == ("spam-farm.example.org", "", None, "block")
    assert got[8] == ("m.casino-win.example.net", "/a", None, "block")
    assert got[9][3] == got[10][3] == "allow"
    assert {r["verdict"] for r in urlfilter.judged(df.filter("page_id in (0, 9)"), listed(spark, [None, ""])).collect()} == {"allow"}


@pytest.mark.parametrize("shards", [1, 5])
def test_cascade_is_exact(spark, monkeypatch, shards):
    """Hosts under thousands of listed domains of one to four labels, with one cascade or several, and hot shards split."""
    monkeypatch.setattr(urlfilter, "TASK_PAGES", 40)
    draw = np.random.default_rng(13)
    label = lambda: "".join(draw.choice(list("abcdef"), int(draw.integers(1, 4))))
    hosts = [".".join(label() for _ in range(int(draw.integers(1, 5)))) + (".hot.example" if i % 3 == 0 else "") for i in range(1500)]
    names = {".".join(h.split(".")[int(draw.integers(0, 4)) :]) for h in hosts[::5]} - {""} | {"x.hot.example", "nowhere.test"}
    names -= {"example", "hot.example"}
    df = spark.createDataFrame([(i // 2, f"x://{h}/p") for i, h in enumerate(hosts)] + [(None, None), (1, "x:///")], "page_id long, url string").repartition(4)
    got = Counter((r["page_id"], r["host"], r["verdict"]) for r in urlfilter.judged(df, listed(spark, [*names, *names]), rules=(("allow", "never.test", "/"),), shards=shards).collect())
    block = lambda h: any(h == d or h.endswith("." + d) for d in names)
    want = Counter((i // 2, h, "block" if block(h) else "allow") for i, h in enumerate(hosts)) + Counter([(None, "", "allow"), (1, "", "allow")])
    assert got == want and 100 < sum(n for (_, _, v), n in want.items() if v == "block") < 1400
    universe = df.select(urlfilter.parts(df["url"])[0].alias("host")).selectExpr("host AS domain").distinct()
    assert len(urlfilter.built(universe, listed(spark, names), shards).levels) > 2


def test_toxicity(spark, docs):
    """Held-out rows of sf0.1: area under the curve, and at 0.7 recall and false alarms. Some labels have no word for it."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    toxic, clean = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    area = np.mean([(clean < s).mean() + (clean == s).mean() / 2 for s in toxic])
    assert len(toxic) > 100 and area > 0.95 and (toxic >= 0.7).mean() > 0.7 and (clean >= 0.7).mean() < 0.005
    assert all(r["score"] == 0 for r in toxicity.scored(docs[1], labels.filter("false")).collect())


def test_toxicity_of_planted_words(spark):
    """Words that only toxic rows hold are learnt from few rows; nulls and empty texts get the intercept's score."""
    draw = np.random.default_rng(15)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(draw.choice(words, 30)) + (" foul" if i % 4 == 0 else "")) for i in range(600)] + [(700, None), (701, ""), (701, ""), (None, "foul w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.scored(df, labels).collect():
        got.setdefault(r["doc_id"], []).append((r["score"], r["predicted"]))
    assert all(got[i][0][1] == (i % 4 == 0) for i in range(600))
    assert got[700] == got[701][:1] and got[701][0] == got[701][1] and not got[None][0][0] < 0.7


def test_pieces(docs):
    import sentencepiece

    rows, df = docs
    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in pieces.digests(df, path, check_every=1).collect()}
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"], got[doc_id]["decoded_sha256"]) == (len(ids), SHA(" ".join(map(str, ids))), SHA(library.decode(ids)))
    whole = {r["doc_id"]: r for r in pieces.encoded(df, path).collect()}
    assert whole[1000]["ids"] == [2] and whole[1009]["decoded"] == ODD[9]


def test_step_merges_are_agenda_merges():
    vocabulary = pieces.coder_of(queries.tokenizer_path("piece_bpe_32k.model")).vocabulary
    chunks = ["▁hello", "▁▁▁", "\nabcabc", "▁\x00ü😀", "▁" + "ab" * 30, "x"]
    assert vocabulary.merge_all(chunks) == [vocabulary.merge(c) for c in chunks]


def test_pieces_checked_against_the_library(spark, monkeypatch):
    """Of each batch the first text is checked, and all chunks of rare sorts; small caches and clashing columns change nothing."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = ["plain words only", "two  blanks", "x" * 200, "not in it: 𓀀", "a\n b", "plain words", "  ", "\n\n𓀀 x▁▁y"]
    odd, check = [], pieces.check_chunks
    monkeypatch.setattr(pieces, "check_chunks", lambda path, found: odd.extend(found) or check(path, found))
    pieces.Coder(path).code(texts, True)
    assert {"▁▁blanks", "x" * 200, "𓀀"} <= set(odd) and not {"plain", "words"} & set(odd)
    with pytest.raises(AssertionError):
        check(path, {"hello": [5]})
    texts, checked = texts[:6], []
    monkeypatch.setattr(pieces, "check_batch", lambda path, texts, ids, decoded: checked.extend(texts))
    monkeypatch.setattr(pieces, "CACHE_CHARS", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5, 6], "text": texts})
    got = [t for part, *_ in pieces._coded([batch, batch.slice(5), batch.slice(0, 1)], path, 512) for t in part.column("text").to_pylist()]
    assert checked == [texts[0], texts[5], texts[0]] and got == texts + checked[1:]
    df = spark.createDataFrame([(1, "w " * 300_000 + "x" * 5_000, "y"), (1, None, "y"), (None, "a", None)], "doc_id long, text string, ids_sha256 string")
    own = {(r["doc_id"], r["n_tokens"]) for r in pieces.digests(df, path).collect()}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert own == {(1, len(library.encode("w " * 300_000 + "x" * 5_000)) + 1), (1, 1), (None, len(library.encode("a")) + 1)}


def test_topk(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.2, 16)]) for i in range(900)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (950, None), (1000, [float("nan")] * 16), (1001, [None] * 16), (1050, []), (1100, [0.0] * 16), (1101, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    sound = {i: np.array([int(np.floor(256 * x)) for x in v] + [0] * (16 - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sound:
        if q % 50 == 0:
            best = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_in_blocks(spark, monkeypatch):
    """Several cells of candidates and blocks of queries, repeated ids, and columns with other names of ours."""
    monkeypatch.setattr(topk, "CELL", 200)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    draw = np.random.default_rng(4)
    rows = [(int(i) % 700, [float(np.float32(x)) for x in draw.normal(0, 0.2, 8)], "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    want = {}
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows]
    for q, v in whole:
        if q % 50 == 0:
            want.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    firsts = {q: sorted(x)[:5] for q, x in want.items()}
    assert got == sorted((q, n + 1, i, -s) for q, x in firsts.items() for n, (s, i) in enumerate(x))


@pytest.mark.parametrize("large", [1, 10_000, 10_000_000, 1 << 40])
def test_topk_of_queries_larger_than_candidates(large):
    """Bounds are exact whatever the sizes of queries and candidates, over several lanes of candidates."""
    draw = np.random.default_rng(6)
    for _ in range(8):
        cells = [topk.Lists(np.arange(at, at + 2000), draw.integers(-3, 4, (2000, 16)) + 100) for at in (0, 2000)]
        queries = draw.integers(-3, 4, (70, 16)) + large * draw.choice([-1, 1], (70, 16))
        for cell in cells:
            for q, (few, score) in zip(queries, cell.top(queries, np.full(70, -1), 5), strict=True):
                whole = cell.vectors @ q
                want = np.lexsort((cell.ids, -whole))[:5]
                assert few.tolist() == want.tolist() and score.tolist() == whole[want].tolist()


def test_topk_stops_early():
    """Where some vectors stand out, a few stretches of the lists are enough, and few scores are resolved."""
    draw = np.random.default_rng(7)
    vectors = np.where(draw.random((4000, 4)) < 0.01, draw.integers(200, 256, (4000, 4)), draw.integers(0, 20, (4000, 4)))
    cell = topk.Lists(np.arange(4000), vectors)
    list(cell.top(vectors[:256] + 1, np.arange(256), 5))
    assert cell.start <= 2 and cell.resolved / cell.stops <= 600


def voted(words):
    """Labels that the diagonals of a text give, and the largest share of a template; in plain loops."""
    labels, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        parts = template.split()
        k = min(licenses.K, len(parts))
        at = [tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)]
        diagonals = {}
        for pos in range(len(words) - k + 1):
            for i, other in enumerate(at):
                if tuple(words[pos : pos + k]) == other:
                    diagonals.setdefault(pos - i, []).append((pos, i))
        held, last = [], None
        for d in [*sorted(diagonals), None]:
            if d is None or (last is not None and d - last > licenses.NEAR):
                longest = [0] * len(held)
                held.sort()
                for i, (p, q) in enumerate(held):
                    longest[i] = 1 + max((longest[j] for j in range(i) if held[j][0] < p and held[j][1] < q), default=0)
                cover = max(longest, default=0) / len(at)
                if cover >= licenses.COVER:
                    labels.add(label)
                    best = max(best, cover)
                held = []
            held = held + diagonals.get(d, [])
            last = d
    return labels, best


def test_licenses(docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        added, score = voted(words)
        assert r["labels"] == ",".join(sorted({label for _, label in found} | added))
        assert r["score"] == (1.0 if found else pytest.approx(score))


def test_license_notices(spark):
    notice = licenses.NOTICES["bsd"][0].split()
    texts = ["before " + " ".join(notice).upper() + " after", "x " + " ".join(notice[:9] + ["new"] + notice[9:]), " ".join(notice[:5]), "nothing here"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["bsd", "bsd", "", ""] and got[0]["score"] == 1.0 and got[3]["score"] == 0.0


def test_license_rows_of_one_id(spark):
    """Votes belong to a row, not to its id; rows without an id are judged too; words in another order are no notice."""
    notice = licenses.NOTICES["mit"][0]
    words = notice.split()
    turned = " ".join(w for i in range(len(words) - 4, -1, -4) for w in words[i : i + 4])
    rows = [(1, notice), (1, "nothing here at all"), (None, notice), (None, "other words"), (2, turned), (2, None), (3, notice), (3, notice)]
    got = Counter((r["doc_id"], r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, "mit", 1.0): 1, (1, "", 0.0): 1, (None, "mit", 1.0): 1, (None, "", 0.0): 1, (2, "", 0.0): 2, (3, "mit", 1.0): 2})


def test_aligned_is_the_longest_rising_chain():
    draw = np.random.default_rng(8)
    for _ in range(40):
        m = list({(int(a), int(b)) for a, b in draw.integers(0, 9, (12, 2))})
        best = max((len(c) for n in range(1 << len(m)) for c in [sorted(m[i] for i in range(len(m)) if n >> i & 1)] if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:], strict=False))))
        assert licenses.aligned([x for x, _ in m], [y for _, y in m]) == best


def test_license_lines(spark, docs):
    """Short lines, as documents hold them, are labelled where no phrase is."""
    lines = {"all": "x\nAll rights reserved.\ny", "cc": "Licensed under CC BY-NC 4.0.", "spdx": "SPDX-License-Identifier: BSD-3-Clause", "none": "SPDX-License-Identifier: all rights", "odd": "no such line"}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(lines.values())), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == ["proprietary", "cc", "bsd", "", ""]
    own = licenses.scan(spark.createDataFrame([(0, "a b"), (1, "b a")], "doc_id long, text string"), [("two", "a b")]).collect()
    assert {r["doc_id"]: r["labels"] for r in own} == {0: "two", 1: ""}
    rows, df = docs
    wanted = {d: "proprietary" if "All rights reserved." in t else "cc" for d, t, _ in rows if t and ("All rights reserved." in t or "Licensed under CC " in t)}
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert len(wanted) >= 4
    for d, label in wanted.items():
        assert label in found[d]["labels"].split(",") and label not in found[d]["base_labels"] and found[d]["score"] == 1.0


def test_mixing(docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in mixing.shares(df).collect()}
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    total = Counter()
    for d, s in source.items():
        total[s] += sizes[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.filled(np.array([total[s] for s in names]), np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float)), strict=True))
    taken = Counter()
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[d], total[source[d]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - goal[source[d]]) < 1e-6
        taken[source[d]] += r["taken"]
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK + 0.004 * goal[s] for s in names)
    assert {d: r["taken"] for d, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.shares(df.repartition(2)).collect()}
    text = Counter()
    for r in mixing.mixed(df).collect():
        text[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert all(text[d] == r["taken"] for d, r in got.items())


def test_mixed_texts_are_runs(spark, monkeypatch):
    """What is taken of a document is the whole of it or a run of it, line ends included; with several districts."""
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 400)
    monkeypatch.setattr(mixing, "DISTRICT", 3)
    draw = np.random.default_rng(12)
    rows = [(i if i % 11 else None, " \t".join(["".join(draw.choice(list("abc"), 3)) + "\n" * int(draw.integers(0, 2)) for _ in range(int(draw.integers(0, 300)))]), f"s{i % 3 if i % 5 else 0}", "x") for i in range(150)]
    rows += rows[:3] + [(500, None, None, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    shares = mixing.shares(df).collect()
    assert len(shares) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in shares)
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, set()).add(t)
    taken, partial = Counter(), 0
    for r in mixing.mixed(df).collect():
        assert r["text"] in texts[r["doc_id"]] or any(t and r["text"] in t for t in texts[r["doc_id"]])
        assert r["text"].rstrip(" \t\n") == r["text"] or r["text"] in texts[r["doc_id"]]
        partial += r["text"] not in texts[r["doc_id"]]
        taken[r["doc_id"]] += size(r["text"])
    want = Counter()
    for r in shares:
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want and 0 < partial < 60
    for s in {r["target"] for r in shares}:
        own = [r for r in shares if r["target"] == s]
        assert abs(sum(r["taken"] for r in own) - s) <= 2 * mixing.BLOCK + 0.01 * s or s == 0


def test_apportionment_is_highest_quotients():
    draw = np.random.default_rng(5)
    for _ in range(30):
        votes, seats = draw.integers(0, 60, 9).astype(float), int(draw.integers(0, 80))
        most = draw.integers(0, 15, 9)
        out = np.zeros(9, int)
        for _ in range(int(min(seats, most[votes > 0].sum()))):
            open_ = (out < most) & (votes > 0)
            out[int(np.argmax(np.where(open_, votes / (2 * out + 1), -1)))] += 1
        assert mixing.apportioned(votes, most, seats).tolist() == out.tolist()


@pytest.mark.parametrize("bytes_", [60_000, 2_000])
def test_fingerprints(docs, monkeypatch, bytes_, spark):
    """Also with rows that repeat an id or have none, spread over several ranges."""
    rows, df = docs
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", bytes_)
    monkeypatch.setattr(fingerprint, "CHUNK", 64 if bytes_ < 10_000 else fingerprint.CHUNK)
    fingerprint._powers.cache_clear()
    more = [(7 if i % 2 else None, f"row {i} of one id " * 9, None) for i in range(60)] + [(None, "same", None)] * 3 + [(7, "same", None)] * 3
    rows = rows + more
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string")).repartition(3)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    ordered = sorted(((d is None, d or 0, hashes[t or ""], t or "") for d, t, _ in rows))
    whole = [(None if none else d, t) for none, d, _, t in ordered]
    got = {}
    for r in fingerprint.fingerprints(df).collect():
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    wanted = Counter()
    for (doc_id, text), (_, after) in zip(whole, whole[1:] + whole[:1], strict=True):
        tail = len(text) // 2
        edited = text[: len(text) - tail] + after[:tail]
        key = (doc_id, len(text), SHA(edited))
        wanted[key] += 1
        r, own, other, following = got[key][0], fingerprint.Print(text), fingerprint.Print(edited), fingerprint.Print(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.name, other.name)
        assert (own.name == following.name) == (text == after) and (r["near_next"] == 1.0 or text != after)
        same = next((i for i, (a, b) in enumerate(zip(text, edited)) if a != b), min(len(text), len(edited)))
        assert r["lce_edited"] == same and 0 <= r["near_next"] <= 1
    assert wanted == Counter({k: len(v) for k, v in got.items()})
    fingerprint._powers.cache_clear()


def test_likeness_of_true_span_sets():
    """The sketches' likeness against the share of spans in common, over edited and unrelated texts."""
    rows = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if r["text"] and len(r["text"]) > 300][:80]
    spans = lambda t: {t[i : i + fingerprint.SPAN] for i in range(len(t) - fingerprint.SPAN + 1)}
    errors = []
    for text, after in zip(rows, rows[1:] + rows[:1], strict=True):
        for share in (0.1, 0.5, 0.9):
            keep = int(len(text) * share)
            other = text[:keep] + after[: len(text) - keep]
            a, b = spans(text), spans(other)
            errors.append(fingerprint.likeness(fingerprint.Print(text).sketch, fingerprint.Print(other).sketch) - 2 * len(a & b) / (len(a) + len(b)))
    assert np.sqrt(np.mean(np.square(errors))) < 0.09 and abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.35
    assert fingerprint.likeness(fingerprint.Print("").sketch, fingerprint.Print("").sketch) == 1.0


def test_long_text(spark):
    """A text of many chunks, and of characters of all sizes: prefix arrays against plain sums, and its row."""
    text = "aé😀" * 20_000 + "tail"
    prefixes = fingerprint.Print(text).prefixes
    for p, array in zip(fingerprint.PRIMES, prefixes.arrays, strict=True):
        h, want = 0, [0]
        for c in text:
            h = (h * fingerprint.BASE + ord(c) + 1) % p
            want.append(h)
        assert array.tolist() == want
    assert prefixes.same(0, prefixes, 30_000, 29_000) and prefixes.extension(0, prefixes, 3) == 59_997
    r = fingerprint.fingerprints(spark.createDataFrame([(1, text, 2)], "doc_id long, text string, _range int")).first()
    half = text[: len(text) - len(text) // 2]
    assert (r["n_chars"], r["near_next"], r["edited_sha256"]) == (len(text), 1.0, SHA(half + text[: len(text) // 2]))


def test_span_equality():
    a, b = fingerprint.Print("abcXabcabc").prefixes, fingerprint.Print("zzabcab").prefixes
    assert a.same(4, b, 2, 5) and not a.same(0, b, 2, 4) and a.extension(4, b, 2) == 5 and a.extension(0, a, 7) == 3


def test_chat(spark):
    turns = [(1, 1, "assistant", "a <|im_end|>\n\\ <|im_start|>assistant ok 😀 é  "), (1, 0, "user", "hi"), (2, 0, "assistant", ""), (2, 1, None, None), (3, 0, "ass\nistant", "x\\"), (None, None, "assistant", " lead and trail \n"), (4, 0, "assistant", "one"), (4, 0, "assistant", "one")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.formatted(df, queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, t))
        under = "".join(t[2] for t in own if t[1] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), SHA("".join(f"{a}\n{b}\n" for _, a, b in own)), len(under), SHA(under))
    assert chat.unescape(chat.escape("<|x|> \\<\\|")) == "<|x|> \\<\\|"
    for r in chat.rendered(df, queries.tokenizer_path("byte_bpe_50k.json")).collect():
        assert len(r["ids"]) == len(r["mask"]) and r["formatted"].count(chat.START) == 1


def test_chat_pieces_are_the_whole(spark, monkeypatch):
    """Conversations cut before turns give the tokens and digests of whole ones; columns of our names are in no way."""
    texts = ["word <|endoftext|> é😀", "", "<|im_end|>\n\n<|im_start|>", "\\<|", " tail \t"]
    turns = [(c, i, ("user", "assistant")[i % 2], " ".join(texts[(c + i * j) % 5] for j in range(30)), "x", "y") for c in range(4) for i in range(20)] + [(9, 0, "assistant", "long text " * 70_000, "x", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, ids string, n_turns string")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    whole, ids = sorted(chat.formatted(df, path).collect()), {}
    for r in chat.rendered(df, path).collect():
        ids.setdefault(r["conv_id"], {})[r["turn"]] = (r["formatted"], r["ids"], r["mask"])
    coder = chat.tokenizer(path)
    for r in whole:
        own = [ids[r["conv_id"]][t] for t in sorted(ids[r["conv_id"]])]
        every, spans = chat.encode(coder, "".join(t for t, _, _ in own))
        assert every == [i for _, x, _ in own for i in x] and len(every) == r["n_tokens"]
        assert sum(sum(m) for _, _, m in own) == r["loss_tokens"]
        under = "".join(t for c, i, role, t, *_ in turns if c == r["conv_id"] and role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(under), SHA(under))
        assert 50257 in every and 50258 in every and spans[0] == (0, len(chat.START))
    monkeypatch.setattr(chat, "WHOLE", 300)
    assert sorted(chat.formatted(df, path).collect()) == whole
