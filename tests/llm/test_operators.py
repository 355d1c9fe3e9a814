"""Brute-force checks and edge cases of the numbered operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
SF = "/root/testdata/sf0.001"
WORDS = "the of and ein der die und le la les que un una los para thing nation".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "ion"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(4)]
    out = [None, "", " \n ", "x", "zz zz", prose(rng, 4000)]
    for b in base:
        words = b.split()
        out += [b, b, b.upper()]
        for _ in range(4):
            w = list(words)
            w[rng.randrange(60)] = "changed"
            out.append(" ".join(w))
    return out + [prose(rng, rng.randrange(1, 80)) for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "s", None, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[7], None, None, None, None, None)]  # a repeated row and a null id
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, bucket int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_language_id(spark, docs):
    from polyrisk.llm.langid import Lattice, predict, train

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(table.where(~held), f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = predict(table.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    edge = {(r.doc_id, r.lang_pred, r.score) for r in predict(docs.drop("lang"), model).where("doc_id < 3").collect()}
    assert edge == {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)}
    assert predict(empty(spark), model).count() == 0
    nothing = train(empty(spark), f"{TOKENIZERS}/piece_bpe_32k.model")
    assert {r.lang_pred for r in predict(docs, nothing).collect()} == {"und"}
    # The forward algorithm sums all segmentations.
    pieces = ["▁", "▁a", "a", "ab", "b"]
    probs = np.array([[0.1], [0.2], [0.3], [0.25], [0.15], [0.0], [1e-7]])
    want = 0.1 * 0.3 * 0.15 + 0.1 * 0.25 + 0.2 * 0.15
    assert math.isclose(Lattice(pieces).log_probs(["ab"], probs)[0, 0], math.log(want))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length", [2, 20, 50])
def test_repeats(spark, length):
    from polyrisk.llm.suffixes import difference_cover, remove_repeats

    rng = random.Random(length)
    base = ["".join(rng.choice("ab cdé") for _ in range(300)) for _ in range(6)]
    texts = [None, "", "x"] + ["".join(base[rng.randrange(6)][a : a + rng.randrange(1, 120)] for a in [rng.randrange(200) for _ in range(5)]) for _ in range(30)] + ["ab" * 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame, length).collect()}
    assert got == dict(enumerate(brute_repeats(texts, length)))
    for n in (2, 20, 200, 400):
        v, cover = difference_cover(n)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeats_edges(spark, docs, texts):
    from polyrisk.llm.suffixes import remove_repeats

    rows = remove_repeats(docs, 100, keep_bytes=True).collect()
    want = Counter(brute_repeats([*texts, texts[6], texts[7]], 100))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert remove_repeats(empty(spark)).count() == 0


def test_repeats_at_400_bytes(spark, tmp_path):
    """Passages of over 50 words go from 400 bytes on and stay below; n_bytes is the size of the input."""
    from polyrisk.llm.queries import op2_suffix_array_dedup

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    short, full = words(67)[:399], words(67)[:400]
    assert min(len(short.split()), len(full.split())) > 50
    texts = [f"{words(90)} {i}{passage}{i} {words(90)}" for i, passage in enumerate([short, short, full, full, words(67), words(67)])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op2_suffix_array_dedup(spark, str(tmp_path)).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute_repeats(texts, 400)
    assert [r.n_removed for r in rows] == [0, 0, 400, 400, 0, 0]
    assert [r.n_bytes for r in rows] == [len(t) for t in texts]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def test_near_duplicates(spark, docs, texts):
    from polyrisk.llm.neardup import near_duplicates

    sets = [shingle_set(t) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    low[a] = min(low[a], low[b])
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert near_duplicates(empty(spark)).count() == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pii(spark):
    from polyrisk.llm.pii import permute_numbers, permute_string, pseudonymise

    text = "a.b7@x.org +1 (017) 555-7713 4952935900253052 4952-9359-0025-3052 1234567890123456 2020-02-29 2020-02-30 10.0.0.1 999.1.1.1 123-45-6789 000-12-1234"
    frame = spark.createDataFrame([(1, text), (2, "see 4952935900253052."), (3, None), (4, ""), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pseudonymise(frame, "k").collect()}
    mail, plus, area, tail, card, spaced, bad, day, noday, ip, noip, ssn, nossn = re.match(r"(\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+)$", got[1]).groups()
    assert mail.endswith("@x.org") and mail != "a.b7@x.org" and re.fullmatch(r"[a-z]\.[a-z]\d@x\.org", mail)
    assert plus == "+1" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", f"{area} {tail}") and (area, tail) != ("(017)", "555-7713")
    assert card != "4952935900253052" and luhn(card) and spaced.replace("-", "") == card
    assert (bad, noday, noip, nossn) == ("1234567890123456", "2020-02-30", "999.1.1.1", "000-12-1234")
    assert day != "2020-02-29" and re.fullmatch(r"\d{4}-\d\d-\d\d", day) and ip != "10.0.0.1" and ssn != "123-45-6789"
    assert got[2] == f"see {card}." and got[3] is None and got[4] == ""
    pairs = spark.range(9 * 50).select(permute_numbers(F.col("id") % 9, F.floor(F.col("id") / 9), 9, 50, "k", "t").alias("p"))
    assert pairs.distinct().count() == 450 and pairs.where("p.x between 0 and 8 and p.y between 0 and 49").count() == 450
    strings = spark.range(1000).select(permute_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("s"))
    assert strings.distinct().count() == 1000
    assert pseudonymise(empty(spark), "k").count() == 0


def test_language_model(spark, docs, texts):
    from polyrisk.llm.pitmanyor import score_texts

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = score_texts(docs, held).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter()
    for i, t in [*enumerate(texts), (6, texts[6])]:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts) + 2
    for r in rows:
        own = tokens(texts[7 if r.doc_id is None else r.doc_id])
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r.score < 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = score_texts(table, held).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]
    assert score_texts(empty(spark), held).count() == 0


def test_seating_totals():
    from polyrisk.llm.pitmanyor import seat

    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 5, 1000, 200_000])
    tables = seat(rng, customers, np.full(6, 0.5), 0.5)
    assert (tables <= customers).all() and (tables[1:] >= 1).all() and tables[0] == 0
    # A dish served from an endless parent opens a table for nearly every customer.
    assert seat(rng, np.array([50]), np.array([1e9]), 0.5)[0] == 50


def test_mixing(spark, docs):
    from polyrisk.llm.mixing import mix

    rng = random.Random(1)
    rows = [(i, prose(rng, 20) + (" awful stupid" if i % 3 == 0 else " fine")) for i in range(300)]
    frame = spark.createDataFrame([*rows, (300, None), (301, ""), rows[0]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "bad" if i % 3 == 0 else "good") for i in range(0, 200)] + [(None, "bad"), (5, None)], "doc_id bigint, domain string")
    out = mix(frame, labels, {"bad": 0.1, "good": 0.9})
    total = out.agg(F.sum("n_tokens")).first()[0]
    got = out.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[k]) / total for k in range(2))).first()
    assert abs(got[0] - 0.1) < 1e-4 and abs(got[1] - 0.9) < 1e-4
    assert out.where("rate < 0 OR abs(copies - rate) >= 1").count() == 0 and out.count() == 303
    assert mix(docs, labels.limit(0), {}).where("rate <> 1").count() == 0
    clash = mix(frame.withColumn("Rate", F.lit("x")).withColumn("copies", F.lit(9)), labels, {"bad": 0.1, "good": 0.9})
    assert sorted(r.copies for r in clash.collect()) == sorted(r.copies for r in out.collect())
    assert mix(empty(spark), labels, {"bad": 0.1, "good": 0.9}).count() == 0


def test_hamming(spark):
    from polyrisk.llm.hamming import sign_codes, top_k

    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 40))
    vectors = [(i, [float(x) for x in centre[i % 6] + 0.4 * rng.standard_normal(40)]) for i in range(300)] + [(300, None), (301, []), (None, [1.0] * 40), (302, [1.0] * 40), (303, [1.0] * 40)]
    codes = sign_codes(spark.createDataFrame(vectors, "id bigint, v array<double>"), "id", "v")
    got = {}
    for r in top_k(codes, codes.where("id % 20 = 0 OR id = 302"), 7, shard_rows=64, block_rows=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    bits = {i: np.array(v) > 0 for i, v in vectors if v and i is not None}
    for q, found in got.items():
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:7]
        assert [(d, i) for _, d, i in sorted(found)] == want
    assert set(got) == {i for i in bits if i % 20 == 0 or i == 302}
    assert top_k(codes.limit(0), codes, 3).count() == 0


def test_rates_are_evaluated_once_below_a_filter_on_copies(spark):
    from polyrisk.llm.mixing import mix

    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "BAD BAD!!") for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(4)], "doc_id bigint, domain string")
    mixed = mix(docs, labels, {"good": 0.9, "bad": 0.1})
    kept = mixed.where("copies > 0").select("doc_id", "copies")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(kept.collect()) == sorted((r.doc_id, r.copies) for r in mixed.collect() if r.copies > 0)


def test_what_a_worker_keeps_of_a_tokenizer_is_bounded(monkeypatch):
    from polyrisk.llm import packing

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    encode = packing.load_encoder(path)
    monkeypatch.setattr(packing, "CACHE_UNITS", 50)
    monkeypatch.setattr(packing, "_units", {})
    texts = [" ".join(f"w{i % 7} n{i}" for i in range(k, k + 300)) for k in (0, 200)] + [f"a {'long' * 1000} b"]
    for text in texts:
        assert np.frombuffer(packing.tokenise([text], path)[0], "<u4").tolist() == encode(text)
        assert 0 < len(packing._units[path]) <= 50
    assert max(map(len, packing._units[path])) <= packing.CACHE_CHARS


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    from polyrisk.llm.packing import best_fit, pack, tokenise

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = ["a  b", " a", "a ", "a\n b", "a \n b", "a\n\n b", "\n a", "a   b ", "a\t b", "  ", "don't <|endoftext|> ñ 12345"]
    for text, ids in zip(odd, tokenise(odd, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    rows = pack(docs, path, 64, group_pieces=20, max_docs=5).collect()
    everything = Counter()
    for i, t in [*enumerate(texts), (6, texts[6]), (None, texts[7])]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = piece = 0
        while at < len(ids):
            n = (len(ids) - at) % 64 or 64
            everything[(i, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at, piece = at + n, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == everything
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64 and len(held) <= 5
    # By residual norm 4 joins 6 (nothing left); by dot product it joins 5, whose bin has more room.
    for rule, want in (("norm", [1, 2, 1, 2, 2, 0]), ("dot", [1, 2, 2, 1, 3, 0])):
        where, _ = best_fit(np.array([6, 5, 4, 3, 2, 10]), 10, 4, 100.0, (1, 0.001, 0.001), rule)
        assert where.tolist() == want
    assert len(set(best_fit(np.array([6, 4, 5, 5]), 10, 4, 50.0, (1, 1, 1), "norm")[0])) == 3  # 6 and 4 exceed the attention
    assert pack(empty(spark), path).count() == 0


def test_lattice(spark):
    from polyrisk.llm.lattice import ROOTS, decode, near_vectors

    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 8)) * 2
    y = decode(x)
    assert all((((x - y) ** 2).sum(1) <= ((x - y - r) ** 2).sum(1) + 1e-9).all() for r in ROOTS) and len(ROOTS) == 240
    base = rng.standard_normal((60, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i, b in enumerate(base):
        rows += [(10 * i, b.tolist(), i % 3), (10 * i + 1, (2 * b).tolist(), i % 3), (10 * i + 2, b.tolist(), None if i % 2 else i % 3)]
        for k in range(3):
            noise = rng.standard_normal(64)
            rows.append((10 * i + 3 + k, (b + 0.19 * noise / np.linalg.norm(noise)).tolist(), i % 3))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, [1.0], 1), (905, [], 1), rows[0]]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    links = Counter()
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for a, (i, u, p) in enumerate(usable):
        for b, (_, w, q) in enumerate(usable):
            if a != b and p == q and len(u) == len(w) and u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= 0.98:
                links[i] += 1
    got = near_vectors(frame, block=4).collect()
    assert len(got) == len(rows)
    repeats = Counter(r[0] for r in rows)
    found, total = sum(r.n_links for r in got), sum(n * repeats[i] if repeats[i] == 1 else n for i, n in links.items())
    assert 0.99 * total <= found <= total
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id >= 900} == {i: (0, i) for i in range(900, 906)}
    assert near_vectors(frame.limit(0)).count() == 0


def test_html(spark):
    from polyrisk.llm.htmltext import extract, main_text

    page = "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Big &amp; small</h1><p>One <b>t</b>wo\n three<p>Ti.<br>end<script>var a='<p>x</p>'</script><aside>side</aside><section id='comments'><p>reader says</p></section></article><form>f</form><footer>foot"
    assert main_text(page) == "Big & small One two three Ti. end"
    plain = "<div id=sidebar>x y</div><div class=content><p>Hello all of you who are here to see this now</p><p>Ti.</p></div><div class='cookie-notice'>ok</div>"
    assert main_text(plain) == "Hello all of you who are here to see this now Ti."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "v", "<nav>only</nav>"), (4, "w", "<p>" + "long " * 200_000)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter({(1, 33): 2, (2, 0): 1, (3, 0): 1, (None, 0): 1, (4, 999_999): 1})
    assert all(r.n_chars == len(r.text) for r in got)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, "the thing that was", None, None, None), (9001, None, "en", "x", 1), (9002, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(nulls).unionByName(docs.limit(3))
    counts = []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts[0] >= 0.95 * 200 and counts[1] <= counts[0] and counts[2] == counts[1]
    assert P.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_mixing_rounds_read_points_alone(spark, monkeypatch):
    """A round of the fit reads packed (n, p) blocks, not the rows with their texts."""
    from polyrisk.llm import mixing as M

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    n = rng.integers(0, 50, 500).astype(float)
    monkeypatch.setattr(M, "POINTS", 64)
    frame = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n double, p array<double>").repartition(7)
    points = M.packed_points(frame, 3)
    assert points.columns == ["n", "p"] and points.rdd.getNumPartitions() <= 7
    got = [(a, *b) for r in points.collect() for a, b in zip(np.frombuffer(r.n), np.frombuffer(r.p).reshape(-1, 3), strict=True)]
    assert sorted(got) == sorted((a, *b) for a, b in zip(n, p, strict=True))
    goal = np.array([0.7, 0.2, 0.1])
    rates = M.fit_rates(frame, goal)
    totals = (n * rates.of(p)) @ p
    assert np.abs(totals / n.sum() - goal).max() < 1e-4
    assert M.fit_rates(frame.where("n = 0"), goal).steps == []


def test_language_model_contexts_are_whole_words(spark, monkeypatch):
    """The restaurant of a word is that of the whole word before it, also over many buckets."""
    from polyrisk.llm import pitmanyor as P

    words, contexts, sizes = P.tokens_of(pa.array(["Xab p", None, "yab  p xab"]))
    assert sizes.tolist() == [3, 1, 4] and (words[2], words[3], words[7]) == (P.END,) * 3
    assert contexts[[0, 3, 4]].tolist() == [P.START] * 3
    assert contexts[1] == words[0] == words[6] != words[4] == contexts[5] and contexts[7] == words[6]
    assert (P.unpacked([P.packed(words)]) == words).all()
    rng = random.Random(3)
    rows = [(i, text, False) for i, text in enumerate(["xab p"] * 40 + ["yab q"] * 40 + [prose(rng, 30) for _ in range(60)])]
    rows += [(900, "xab p", True), (901, "xab q", True), (902, "unseen words", True), (903, "yab q", True)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean")
    whole = {r.doc_id: r.score for r in P.score_texts(frame, F.col("held")).collect()}
    assert whole[900] > whole[901] + 1 and whole[903] > whole[901] + 1
    monkeypatch.setattr(P, "BUCKET_PAIRS", 100)
    cut = {r.doc_id: r.score for r in P.score_texts(frame, F.col("held")).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[i] - whole[i]) < 0.02 * abs(whole[i]) + 0.1 for i in whole)


def test_language_model_keeps_its_scratch_small(spark, monkeypatch):
    """Written numbers come back; files of past sweeps go, and what stays is well below the text."""
    from polyrisk.llm import pitmanyor as P
    from polyrisk.session import ensure_checkpoint_dir

    for values in (np.zeros(0, np.int64), np.array([5, 0, 1 << 40, 7, (1 << 48) - 1, 3]), np.arange(1000) * 70_000):
        assert all((P.numbers([P.squeezed(values, steps=s), P.squeezed(values[:2], steps=s)], steps=s) == np.concatenate([values, values[:2]])).all() for s in (False, True))
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    left = lambda: {f: f.stat().st_size for f in Path(top).rglob("pitmanyor*/part-*")}
    rng, before = np.random.default_rng(4), left()
    texts = [" ".join(f"word{w}" for w in rng.zipf(1.3, 400) % 50_000) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(P, "BUCKET_PAIRS", 60_000)
    assert P.score_texts(frame, F.col("doc_id") % 10 == 0).where("score < base_score").count() < 1500
    after = left()
    size = sum(n for f, n in after.items() if f not in before)
    assert size < 0.6 * sum(map(len, texts))
