"""The operators against brute force, exact round trips and planted cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dossierlake.llm import bpe, jaccard, langid, licenses, media, packing, quality, secrets, topk, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "Don't stop", "x" * 3000, "É ß Σσ 漢字 \x1c\x1f", "a <|endoftext|> b", "same text here now", "same text here now", "0123456789abcdef0123456789abcdef"]


def docs(spark, texts, extra=True):
    rows = [(None if i == 3 else i, t, "junk", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, label int")


def empty(spark):
    return docs(spark, []).limit(0)


def test_bpe_is_the_library(spark):
    library = Tokenizer.from_file(PATH)
    got = {i: r for i, r in enumerate(bpe.encode_decode(docs(spark, ODD).coalesce(1), PATH).collect())}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_digest(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("leaf", [2, 3, 64])
def test_tree_concatenation(leaf):
    enc, library = bpe.load(PATH), Tokenizer.from_file(PATH)
    for word in ("thenationingand" * 40, "a" * 999, "antidisestablishment" * 7 + "e"):
        raw = np.frombuffer(word.encode(), np.uint8)
        symbols = np.r_[enc.inner[raw[:-1]], enc.final[raw[-1:]]]
        ids, counts = enc.tree(np.r_[symbols, symbols[-3:]], np.array([len(word), 3]), leaf)
        assert ids[: counts[0]].tolist() == library.encode(word, add_special_tokens=False).ids
        assert ids.tolist() == enc.merge(np.r_[symbols, symbols[-3:]], np.array([len(word), 3]))[0].tolist()


def test_encoding_of_odd_strings():
    enc, library, rnd = bpe.load(PATH), Tokenizer.from_file(PATH), random.Random(3)
    alphabet = [*"abcdeé'ñ ßΣσÉ漢0 1\t\n\x1c\x0b\xa0.,<|>'st", "<|endoftext|>", "'re", "e\u0301", "\U0001f600", "\U0001d400", "İ", "ǅ", "\u200b", "²", "Ⅷ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", None, "x" * 100_000, "thenationingand" * 20_000]
    held = bpe.Texts(enc, pa.array(["sliced off", *texts], pa.string()).slice(1))
    ids, ends = held.tokens()
    for i, (t, decoded) in enumerate(zip(texts, held.spelled(enc.names))):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_media_round_trip(spark):
    stored = media.encode_texts(docs(spark, ODD))
    got = {r["doc_id"]: r for r in media.digest(stored).collect()}
    assert got[0]["n_bytes"] == 0 and got[0]["payload_bytes"] == 64 and got[5]["payload_bytes"] == 3008
    assert got[8]["media_sha256"] == got[9]["media_sha256"]
    blocks = media.pcm_blocks(stored.filter("doc_id = 5")).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == media.payload_of("x" * 3000) and [b["sample_offset"] for b in blocks] == [0, 1024, 2048]
    broken = bytearray(media.encode([b"y" * 640])[0])
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        media.decode([bytes(broken)])
    assert media.digest(media.encode_texts(empty(spark))).count() == 0


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(spark, width, num, den):
    base = " ".join(f"w{i * i % 89}" for i in range(120))
    texts = [base, base, None, "", "one two", "One  TWO", "one two three"]
    texts += [base.replace(f"w{k}", f"v{k}", 1) for k in range(1, 80, 7)] + [base.replace("w1", "zz") + " tail" * k for k in range(6)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame, width, num, den).collect()}
    assert got == brute_components(texts, width, num, den)


def test_jaccard_edges(spark):
    assert jaccard.link_components(empty(spark)).count() == 0
    got = jaccard.link_components(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (8, 9)} == {8}


def brute_spans(text):
    out = []
    for order, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), order, r.kind, m.end()))
    return sorted(out)


def test_secrets(spark):
    texts = [None, "", "é Password = 'hunter22' x", "token:token:abcdefgh", "AKIA" + "A" * 20 + " AKIA12", "deadbeef" * 4 + " secret=" + "ab12" * 8, "api_key: short", "APIKEY=longenough api_key:\"longer-one\"", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "no secret here", "deadbeef" * 4] * 2
    got = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: [(s["start"], s["order"], s["kind"], s["end"]) for s in r["spans"]] for r in got} == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert secrets.scan(empty(spark)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert clean[0] is None and clean[10] == "no secret here" and clean[2] == "é [SECRET]' x" and clean[11] == "[SECRET]"


def test_trigram_queries():
    for r in secrets.RULES:
        q = secrets.trigram_query(r.pattern)
        assert (q is None) == (r.kind == "hex")


def test_licenses(spark):
    texts = [None, "", "intro\nReleased under the MIT License.\nmore", "released UNDER the mit   license", "This is unrelated text under the sun", licenses.TEMPLATES["MIT-grant"], "Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: (r["license"], r["n_licenses"]) for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(len(texts))] == [None, None, "MIT", "MIT", None, "MIT-grant", "CC-BY-NC-4.0"]
    for grams in map(licenses.bigrams_of, licenses.TEMPLATES.values()):
        words = licenses.anchors(grams)
        assert len([g for g in grams if not set(words) & set(g.split(" "))]) < licenses.THRESHOLD / (2 - licenses.THRESHOLD) * len(grams)
    assert licenses.scan(empty(spark)).count() == 0


def test_topk(spark):
    rnd = random.Random(5)
    vecs = [[rnd.uniform(-1, 1) for _ in range(6)] for _ in range(300)] + [[0.5] * 6] * 4 + [None, [None] * 6, [float("nan")] * 6]
    frame = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    v = topk.integer_vectors(frame)
    ints = {r["vec_id"]: r["v"] for r in v.collect()}
    assert len(ints) == 304
    got: dict = {}
    for r in topk.top_k(v, v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in got:
        scores = sorted(((c, sum(a * b for a, b in zip(ints[q], ints[c]))) for c in ints if c != q), key=lambda x: (-x[1], x[0]))
        assert got[q] == scores[:10]
    assert topk.top_k(v.limit(0), v.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_topk_repeated_rows(spark):
    rnd = random.Random(7)
    once = spark.createDataFrame([(i, [rnd.randint(-9, 9) for _ in range(4)]) for i in range(60)], "vec_id long, v array<long>")
    again = once.unionByName(once.filter("vec_id % 20 = 0 or vec_id < 30")).unionByName(once.filter("vec_id = 20"))
    nearest = lambda v: sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()))
    got = nearest(again)
    assert got == nearest(once) and len(got) == 30 and len({(r[0], r[2]) for r in got}) == 30


def test_packing(spark):
    texts = [None, "", "a b c"] + ["word " * n for n in (5, 300, 900, 1300, 2500, 4095, 4096, 9000)]
    got = packing.pack_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4), PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[:-1] == 4096).all()
        for p in own.itertuples():
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset + s.length).tolist()[:-1] == s.offset.tolist()[1:] and s.offset.iloc[0] == 0 and (s.offset + s.length).max() <= 4096
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 30)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    sizes = [2500] * 100 + [1400] * 300 + [7] * 50  # 200 bins of 2500 + 1400, or one of 2500 and one of 1400
    frame = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    for residue in (2000, 3):
        monkeypatch.setattr(packing, "RESIDUE", residue)
        got = packing.pack(frame).toPandas().sort_values("uid")
        assert got.uid.tolist() == list(range(len(sizes)))
        ends = got.offset + np.array(sizes)
        for _, s in got.assign(end=ends).sort_values("offset").groupby("sequence_id"):
            assert s.end.tolist()[:-1] == s.offset.tolist()[1:] and s.offset.iloc[0] == 0 and s.end.max() <= 4096
        # longest first in one place gives 100 + 100 bins; a part costs one more at most
        assert 200 <= got.sequence_id.nunique() <= 200 + 15


def test_packing_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c")] * 3 + [(None, None)], "doc_id long, text string")
    got = packing.pack_documents(frame, PATH).toPandas().sort_values("offset")
    assert got.length.tolist().count(1) == 1 and len(got) == 4 and got.sequence_id.nunique() == 1 and got.offset.is_unique


def labelled(spark, good, bad, column):
    rows = [(i, f"{good} {i} {chr(97 + i % 26)}ord", 1) for i in range(120)] + [(500 + i, f"{bad} {i} {chr(97 + i % 26)}ord", 0) for i in range(120)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {column} int")


def test_quality(spark):
    model = quality.learn(labelled(spark, "the river runs along the valley and the fields", "$$$ %%% buy now ### click ***", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, ["the river and the valley fields", "$$$ ### click *** buy", None, "", "x" * 5000]), model).collect()}
    assert got[0] > 0.5 > got[1] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(empty(spark), model).count() == 0


def test_toxicity(spark):
    rows = [(i, f"you stupid idiot number{i} go away", 1) for i in range(80)] + [(500 + i, f"some river and valley word{i} here to see", 0) for i in range(300)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    texts = ["an 1d10t here", "so s t u p i d of it", "what an idiooot", "a river", None, "", "stup1d!!!"]
    got = {i: r["score"] for i, r in enumerate(toxicity.score(docs(spark, texts).coalesce(1), model).collect())}
    assert all(got[i] > 0.7 for i in (0, 1, 2, 6)) and all(got[i] < 0.3 for i in (3, 4, 5))
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_disguises():
    texts = ["you are a stupid idiot and an asshole", "some river and valley words are here to see", "the grass and the glass class pass"]
    letters = Counter(("^^" + w + "$")[i : i + 3] for t in texts for w in t.split() for i in range(len(w) + 1))
    model = toxicity.Model({g: 50 * n for g, n in letters.items()}, {"=stupid": 3.0, "=idiot": 3.0, "=ass": 3.0, "^assho": 3.0})
    spaced = lambda s: " ".join(s.replace(" ", ""))
    found = lambda t: model.features(t)[2] == 1.0
    assert all(map(found, [spaced("you are a stupid idiot and an asshole"), "st" + "u" * 60 + "pid", "a s t u p i d", "s*t*u*p*i*d", "s t u p p p i d"]))
    assert all(map(found, ["asshol3", "an idio7.", "a$$", "idiot1", "stupid2", "id1111ot"]))
    assert model.features("s t u p i d i d i o t") == model.features("stupid idiot")
    assert not any(map(found, ["c l a s s", "class3", "g r a s s", "the valley 1234 words", "river5"]))


def test_toxicity_letters_of_all_texts(spark):
    rows = [(i, f"you stupid idiot number{i} go away", 1) for i in range(20)] + [(500 + i, f"some river word{i} here", 0) for i in range(60)]
    labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = ["жук жук ёж"] + ["the river"] * 9 + [None, "", "漢字"] + [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for i in range(300)]
    want = Counter(("^^" + w + "$")[i : i + 3] for t in texts for w in set((t or "").split()) for i in range(len(w) + 1))
    for parts in (1, 7):
        got = toxicity.learn(labels, texts=docs(spark, texts).repartition(parts)).trigrams
        assert len(got) == len(want) and all(got.count(g) == n for g, n in want.items())
        assert got.count("^^") == sum(n for g, n in want.items() if g[:2] == "^^") and got.count("zzz") == 0


def test_languages(spark):
    rows = [(i, f"the cat and the dog run over there {i}", "en") for i in range(40)] + [(100 + i, f"der hund und die katze laufen dort {i}", "de") for i in range(40)] + [(200, None, "fr"), (201, "x", None)]
    f = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, ["the dog and the cat", "die katze und der hund", None, "z", "123 !!", ""]), f).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[2] == ("und", 0.0) and got[4][0] == "und" and got[5][0] == "und"
    assert langid.identify(empty(spark), f).count() == 0


def test_labelled_sample(spark):
    from dossierlake.llm.common import labelled_sample

    texts = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, None, "x"), (3, "", "x"), (None, "n", "x"), (4, "d", "x"), (4, "d", "x"), (5, "e", "x")], "doc_id long, text string, quality string").select("doc_id", "text", "quality")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (None, 1), (4, 0), (5, None), (9, 1)], "doc_id long, quality int")
    got = labelled_sample(texts, labels, "quality", 100)
    assert sorted((r["doc_id"], r["text"], r["quality"]) for r in got.collect()) == [(1, "a", 1), (4, "d", 0)]
    assert labelled_sample(texts.limit(0), labels, "quality", 100).count() == 0
    assert labelled_sample(texts, labels.limit(0), "quality", 100).count() == 0


def test_languages_letters_and_many(spark):
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" * 4 + f" {chr(97 + k % 26)}{chr(98 + k // 26)}yz", f"l{k:02d}") for k in range(70) for i in range(3)]
    f = langid.learn(spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string"))
    assert len(f.languages) == 70 and f.masks.shape[0] == 2
    texts = [rows[3 * 68][1], rows[0][1], "\U0001f600 12", "\U0001d400\U0001d401", "\U00010330\U00010331", rows[0][1] * 30_000]
    got = [r["lang_pred"] for r in sorted(langid.identify(docs(spark, texts).drop("doc_id").selectExpr("monotonically_increasing_id() doc_id", "text", "node as lang").coalesce(1), f).collect())]
    # an emoji is no letter; astral letters are, even if no language has them
    assert sorted(got) == sorted(["l68", "l00", "und", got[3], got[4], "l00"]) and got.count("und") == 1


def test_languages_against_sets(spark):
    rows = [(i, f"the cat and the dog run over there {i}", "en") for i in range(40)] + [(100 + i, f"der hund und die katze laufen dort {i}", "de") for i in range(40)]
    f = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = {x: {g for _, t, lang in rows if lang == x for n in langid.ORDERS for g in langid._grams(langid._codes(t), n).tolist()} for x in f.languages}
    for text in ("the dog", "die katze and the cat", "xyz xyz", "a b"):
        own = [g for n in langid.ORDERS for g in langid._grams(langid._codes(text), n).tolist()]
        exact = np.array([sum(g in grams[x] for g in own) / max(len(own), 1) for x in f.languages])
        assert np.abs(np.maximum(f.shares(text), 0) - exact).max() < 0.02


def test_toxicity_long_words():
    model = toxicity.Model({"^^s": 5, "^st": 5, "stu": 5, "tup": 5, "upi": 5, "pid": 5, "id$": 5}, {"=stupid": 3.0})
    text = "a" * 300_000 + " " + "abab" * 100_000 + " s" + "t" * 50_000 + "upid " + "x-" * 50_000
    import time

    begun = time.time()
    assert model.features(text)[2] == 1.0 and time.time() - begun < 30
    assert toxicity._stretched("xx aaab_bccc 1ddd", str.upper) == "xx AAAB_BCCC 1DDD"


def all_paths(model, span):
    """The cheapest reading of a short stretch of letters and signs without separators, over all spellings."""
    from itertools import product

    best = None
    for spelling in product(*[toxicity.SIGNS.get(c, c) for c in span]):
        w = "^^" + "".join(spelling) + "$"
        cost = sum(model._cost(w[i : i + 2], w[i + 2]) for i in range(len(w) - 2))
        best = min(best, (cost, "".join(spelling))) if best else (cost, "".join(spelling))
    return best[1]


def test_toxicity_against_all_paths():
    words = "shade state stone glass close level signal bottle little".split()
    letters = Counter(("^^" + w + "$")[i : i + 3] for w in words for i in range(len(w) + 1))
    model = toxicity.Model({g: 50 * n for g, n in letters.items()}, {})
    model._prepare()
    for span in ("sh4de", "st0ne", "cl0se", "5igna1", "b0ttle", "l1ttle"):
        assert model.restore(span) == all_paths(model, span)


def test_secrets_very_long_text(spark):
    import time

    text = " ".join(f"token: abcdef{i}" for i in range(20_000)) + " " + "deadbeef" * 5 + " be fed a dad " * 30_000
    begun = time.time()
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["order"], s["kind"], s["end"]) for s in got] == brute_spans(text) and time.time() - begun < 60


def test_redact_keeps_columns(spark):
    text = "x token=abcdef1 y"
    frame = spark.createDataFrame([(7, text, len(text), "a", "b", "c"), (None, None, None, None, None, None), (8, "plain", 99, "a", "b", "c")], "doc_id long, text string, n_chars int, kinds string, spans string, text_key string")
    got = {r["doc_id"]: r for r in secrets.redact(frame).collect()}
    assert secrets.redact(frame).columns == frame.columns
    assert got[7]["text"] == "x [SECRET] y" and got[7]["n_chars"] == 12 and got[7]["spans"] == "b"
    assert got[None]["text"] is None and got[8]["n_chars"] == 99


def test_media_digest_against_plain(spark):
    import hashlib

    texts = [None, "", "same", "same", "é" * 5000, "x" * 70_000]
    got = {r["doc_id"]: r for r in media.digest(media.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert got[2]["feature"] == got[3]["feature"]


def test_quality_against_plain(spark):
    import zstandard

    model = quality.learn(labelled(spark, "the river runs along the valley and the fields", "$$$ %%% buy now ### click ***", "quality"))
    for text in ("the river and the valley fields", "$$$ click", "x" * 500):
        sizes = [len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode())) for d in (model.good, model.bad)]
        assert abs(model.features(text)[0] - (sizes[1] - sizes[0]) / sum(sizes)) < 0.05
    again = quality.learn(labelled(spark, "the river runs along the valley and the fields", "$$$ %%% buy now ### click ***", "quality").repartition(5))
    assert again.good == model.good and np.allclose(again.weights, model.weights)
    twice = labelled(spark, "a b c", "d e f", "quality")
    assert quality.learn(twice.unionByName(twice.selectExpr("cast(null as long) doc_id", "text", "quality"))).weights is not None


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    good = [f"the river runs along the valley and the fields number {i} with water stones and trees {i * 7}" for i in range(60)]
    bad = [f"$$$ %%% buy now ### click *** {i} $$$ ### %%% &&& {i}" for i in range(60)]
    rude = [f"you stupid idiot go away now from river {i} and the valley fields stay there please {i * 3}" for i in range(60)]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(good + bad + rude)] + [(0, good[0], "en", "s", 1, "x"), (300, None, None, None, None, None), (301, "", "en", "s", 0, "x"), (302, "  ", "en", "s", 2, "x"), (None, "river valley fields token=abcdef99", "en", "s", 3, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    labels = [(i, int(i < 60 or i >= 120), int(i >= 120)) for i in range(180)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for frame in (docs, docs.limit(0), docs.unionByName(docs)):
        for name, stage in pipe.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out = out.toPandas()
            assert len(out) <= len(frame.toPandas()) or name == "packing"
    kept = lambda k: set(pipe.STAGES[k][1](spark, docs, str(tmp_path)).toPandas().doc_id.dropna().astype(int))
    assert not kept(0) & set(range(60, 120)) and set(range(60)) <= kept(0)
    assert not kept(1) & set(range(120, 180)) and set(range(60)) <= kept(1)
    one = pipe.STAGES[2][1](spark, docs, str(tmp_path)).toPandas()
    assert (one.doc_id == 0).sum() == 1 and {300, 301, 302} <= set(one.doc_id.dropna()) and one.doc_id.isna().sum() == 1
    assert pipe.run(spark, str(tmp_path)).count() > 0


def test_one_of_each_group_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as pipe

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    frame = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (3, a + " tail")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in pipe.one_of_each_group(spark, frame, "").collect())
    assert got == [(1, a), (1, b)]


def test_licenses_in_other_text(spark):
    grant = licenses.TEMPLATES["MIT-grant"].split()
    wrapped = "\n".join(" ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    texts = ["some prose here\n" + wrapped + "\nand more prose", "In a paragraph, released under the MIT license, it stands among other words.", "/* " + wrapped.replace("\n", "\n * ") + " */ int main", "software without restriction following", "x " * 50_000 + licenses.TEMPLATES["ISC"] + " y" * 50_000]
    frame = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, texts[1], "m")] * 2, "doc_id long, text string, license string")
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(frame).collect()]
    assert sorted(got, key=str) == sorted([(0, "MIT-grant"), (1, "MIT"), (2, "MIT-grant"), (3, None), (4, "ISC"), (None, "MIT"), (None, "MIT")], key=str)


def test_topk_few_rows_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 3)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "STEP", 1)
    frame = spark.createDataFrame([(i, [float(i), 1.0], "x", i) for i in range(7)] + [(None, [1.0, 1.0], "x", 1)], "vec_id long, embedding array<float>, score string, rank int")
    v = topk.integer_vectors(frame)
    got: dict = {}
    for r in topk.top_k(v, v.withColumnRenamed("vec_id", "query_id"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: ([c for c in range(6, -1, -1) if c != q] if q else [1, 2, 3, 4, 5, 6]) for q in range(7)}


def test_topk_empty_and_large_vectors(spark):
    """Empty vectors score 0 with all; scores beyond a long are worked out whole and count as the nearest long."""
    def nearest(rows, k):
        v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        return sorted(map(tuple, topk.top_k(v, v.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), k).collect()))

    assert nearest([(0, []), (1, []), (2, [])], 5) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert nearest([(0, [1.0]), (1, []), (2, [2.0])], 5) == [(0, 1, 2, 2 * 1024**2), (0, 2, 1, 0)]
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0]), (3, [0.5, 3.0]), (4, [1e13, 0.0])]
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows}
    want = sorted((-long(sum(a * b for a, b in zip(whole[0], whole[i]))), i) for i in (1, 2, 3, 4))
    assert nearest(rows, 4) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)]


def test_packing_residue_costs_nothing(spark, monkeypatch):
    """Sending on the roomiest bins alone gives no more sequences than sending on all."""
    rnd = random.Random(8)
    frame = spark.createDataFrame([(i, rnd.choice([rnd.randrange(1, 9), rnd.randrange(1, 4097), 2049])) for i in range(900)], "uid long, length long")
    monkeypatch.setattr(packing, "PART", 60)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    found = []
    for residue in (10**9, 4 * 4):
        monkeypatch.setattr(packing, "RESIDUE", residue)
        found.append(packing.pack(frame).select("sequence_id").distinct().count())
    assert found[0] == found[1]


def test_logistic_does_not_run_away():
    """Features that go together and classes that are nearly apart: the loss falls and the curve tells the classes apart."""
    rnd = np.random.default_rng(5)
    y = (rnd.random(6000) < 0.5).astype(float)
    d = np.where(y == 1, 0.06, -0.09) + 0.03 * rnd.standard_normal(6000)
    rate = np.where(y == 1, -0.7, -1.9) + 0.2 * rnd.standard_normal(6000)
    x = np.column_stack([d, d * (1 - 1e-3 * rnd.random(6000)), rate, rate + d, d * rate])
    w = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    assert np.isfinite(w).all() and ((p >= 0.5) == (y == 1)).mean() > 0.98 and -np.log(np.where(y == 1, p, 1 - p) + 1e-12).mean() < 0.1
    even = quality.logistic(np.ones((4, 1)), np.array([0.0, 1.0, 1.0, 1.0]))
    assert abs(1 / (1 + np.exp(-(even[0] + even[1]))) - 0.75) < 0.01
    apart = quality.logistic(np.array([[0.0], [1.0]] * 20), np.array([0.0, 1.0] * 20))
    assert np.isfinite(apart).all() and apart[0] > 0


def test_quality_of_unequal_samples(spark):
    """A sample of like sizes is set right by the share of good rows among all."""
    rows = labelled(spark, "the river runs along the valley and the fields", "$$$ %%% buy now ### click ***", "quality")
    plain, shifted = quality.learn(rows), quality.learn(rows, share=0.9)
    assert shifted.weights[-1] > plain.weights[-1] and shifted.weights[:-1].tolist() == plain.weights[:-1].tolist()
