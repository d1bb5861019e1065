"""The corpus operators against brute force, on small tables that hold the awkward cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandloom.llm import annsearch, components, contamination, langid, licences, neardup, packing, quality, queries, suffixdedup, textkit, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents(spark, texts, langs=None):
    """Texts as documents with an extra column; (id, text) pairs or texts."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, (langs or {}).get(i), None, None, "x") for i, t in rows], SCHEMA)


AWKWARD = [None, "", " ", "a", "a", "éß İ \n\t", "...", "x" * 30000, "one two three", "one two three", (None, "one two three"), (None, None)]


def all_rows(df):
    return [r.asDict() for r in df.collect()]


# Near-duplicates.


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(12)]
    texts = []
    for k in range(150):  # near copies at all distances, chains among them
        t = list(base[k % 12])
        for p in rng.choice(60, int(rng.integers(0, 6)), replace=False):
            t[p] = str(rng.choice(vocabulary))
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(1000 + i, t) if not isinstance(t, tuple) else t for i, t in enumerate(AWKWARD)]
    got = all_rows(neardup.near_duplicates(documents(spark, rows), width=width))
    assert len(got) == len(rows)
    expected = brute_components(rows, width)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_dedupe_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "other words stand here now"])
    out = neardup.dedupe(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_dedupe_tells_repeated_and_missing_ids_apart(spark):
    texts = [(1, "t u v w x y"), (1, "t u v w x y"), (2, "other words stand here now"), (3, "same id one a b c"), (3, "same id two d e f"), (None, "no id at all here 1"), (None, "no id at all here 1"), (None, "t u v w x y"), (None, None), (None, "")]
    out = neardup.dedupe(documents(spark, texts))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted(
        [("1", "t u v w x y"), ("2", "other words stand here now"), ("3", "same id one a b c"), ("3", "same id two d e f"), ("None", "no id at all here 1"), ("None", "")]
    )


#: Names that the operators use themselves, as columns that a table may bring along.
CLASHING = ["spans", "spans0", "spans1", "kid", "kh", "_a", "_b", "row_key", "own_id", "gone_key", "rep", "key", "score", "component_id", "kept", "n", "w", "h", "v", "y", "label", "rank", "host", "path"]


def test_clashing_names_and_missing_ids_in_the_stages(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    item = "Which of these words stands for the colour of a clear sky at noon? The answer to that is blue as anyone can see."
    texts = [(1, f"left side {passage}"), (2, f"{passage} right side"), (None, f"some words before. {item} And some after it."), (None, "a clean text without anything"), (4, "the same id, clean"), (4, f"the same id. {item}"), (4, "the same id, clean")]
    docs = documents(spark, texts).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string").select("*", *(F.lit(0).alias(c) for c in CLASHING))
    for out in (suffixdedup.strip(docs, words=51), neardup.dedupe(docs), contamination.clean(docs, bench)):
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)
    left = sorted((str(r["doc_id"]), r["text"]) for r in contamination.clean(docs, bench).collect())
    assert left == sorted((str(i), t) for i, t in texts if item not in t)
    assert [r["text"] for r in suffixdedup.strip(docs, words=51).where("doc_id in (1, 2)").orderBy("doc_id").collect()] == ["left side ", " right side"]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


# Repeated strings.


def brute_repeats(rows, length):
    seen = collections.Counter(t[p : p + length] for t in rows for p in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [20000, 3])
def test_suffixes_against_brute_force(spark, split):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    other = "".join(rng.choice(list("abcdefgh "), 450))
    noise = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    texts = [noise(300) + passage + noise(100), noise(50) + passage[100:700] + noise(20), passage, passage, "ab" * 700, noise(800), other + noise(10) + other, noise(5) + other[:399], noise(5) + other[:400] + "é" * 30]
    texts += [noise(int(n)) + passage[200:640] + noise(int(n)) for n in rng.integers(0, 400, 12)]
    rows = [t for t in texts + AWKWARD if not isinstance(t, tuple)]
    got = all_rows(suffixdedup.digest(documents(spark, rows), split=split))
    assert len(got) == len(rows)
    expected = brute_repeats([(t or "").encode() for t in rows], 400)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(expected))


def brute_word_repeats(rows, words):
    """Texts without the strings of so many words that stand elsewhere too."""
    at = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", t)] for t in rows]
    keys = [[tuple(t[a:b] for a, b in w[p : p + words]) for p in range(len(w) - words + 1)] for t, w in zip(rows, at)]
    seen = collections.Counter(k for row in keys for k in row)
    out = []
    for t, w, row in zip(rows, at, keys):
        gone = np.zeros(len(t), bool)
        for p, k in enumerate(row):
            if seen[k] > 1:
                gone[w[p][0] : w[p + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def brute_strip(rows, length=400, words=51):
    """Texts without 400-byte strings and 51-word passages that stand elsewhere too, both judged on the input."""
    at = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", t)] for t in rows]
    keys = [[tuple(t[a:b] for a, b in w[p : p + words]) for p in range(len(w) - words + 1)] for t, w in zip(rows, at)]
    passages = collections.Counter(k for row in keys for k in row)
    strings = collections.Counter(t[p : p + length] for t in rows for p in range(len(t) - length + 1))
    out = []
    for t, w, row in zip(rows, at, keys):
        gone = np.zeros(len(t), bool)
        for p, k in enumerate(row):
            if passages[k] > 1:
                gone[w[p][0] : w[p + words - 1][1]] = True
        for p in range(len(t) - length + 1):
            if strings[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("split", [20000, 1])
def test_passages_of_51_to_60_short_words(spark, split):
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join(f"{k}n" for k in rng.integers(0, 10**9, n))
    passages = {n: " ".join(str(w) for w in rng.choice(list("abcdefghé"), n)) for n in range(49, 61)}
    texts = [f"{noise(int(rng.integers(0, 90)))} {p} {noise(int(rng.integers(0, 90)))}" for p in passages.values() for _ in range(3)]
    texts += [passages[51], passages[55].replace(" ", "\n\t"), noise(9) + " x" + passages[51], " ".join(["la"] * 200), f"{passages[60]} {passages[60]}"]
    rows = [t or "" for t in texts + AWKWARD if not isinstance(t, tuple)]
    got = {r["doc_id"]: r["text"] for r in all_rows(suffixdedup.strip_words(documents(spark, rows), words=51, split=split))}
    assert all(len(p.encode()) < 400 for p in passages.values())
    assert {i: got[i] or "" for i in got} == dict(enumerate(brute_word_repeats([t.encode() for t in rows], 51)))
    assert sum(passages[49] in t for t in rows) == sum(passages[49] in (t or "") for t in got.values()) == 3


def test_pipeline_cuts_short_passages(spark):
    import corpus_pipeline

    passage = " ".join(f"w{k}" for k in range(51))
    docs = documents(spark, [" ".join(f"{side}{k}" for k in range(60)) + f" {passage} {side}" for side in ("left", "right")])
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SF)
    got = [r["text"] for r in docs.collect()]
    assert len(got) == 2 and not any("w25" in t for t in got) and all(len(t.split()) == 61 for t in got)


def test_suffix_ranks_and_prefixes():
    data = np.frombuffer(b"banana_bandana_banana_" * 5 + b"\0" * 40, np.uint8)
    rank = suffixdedup.suffix_ranks(data, 40)
    raw = data.tobytes()
    n = len(raw) - 40
    assert all((rank[i] < rank[j]) == (raw[i : i + 40] < raw[j : j + 40]) for i in range(n) for j in range(n))
    order = np.argsort(rank[:n] * 1000 + np.arange(n))
    plcp = suffixdedup.common_prefixes(data, order, 200)  # heads compared far enough for chains of 110 places
    for a, b in zip(order[:-1], order[1:]):
        true = next((k for k in range(len(raw) - max(a, b)) if raw[a + k] != raw[b + k]), len(raw) - max(a, b))
        assert min(plcp[b], 40) == min(true, 40)


# Packing.


def test_packing_round_trip(spark):
    texts = [t for t in AWKWARD if not isinstance(t, tuple)] + ["word " * 9000, "it's <|endoftext|> a\x0bb don't.", *(f"some text number {i} " * (i % 37 + 1) for i in range(200))]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = all_rows(packing.pack(documents(spark, texts), path, capacity=512, with_ids=True))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    whole = collections.defaultdict(dict)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] and r["start"] == 512 * r["piece"]
        whole[r["doc_id"]][r["piece"]] = r["ids"]
    for i, t in enumerate(texts):
        assert sum((whole[i][p] for p in sorted(whole[i])), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 512) + 3


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40))}
    rows = packing.plan(counts, 100)
    used, bins = collections.Counter(), collections.defaultdict(list)
    for length, lo, hi, each, first, offset in rows.tolist():
        used[length] += hi - lo
        for r in range(lo, hi):
            bins[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert used == counts
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
        assert sum(3 * n > 100 for _, n in b) <= 2
    assert len(bins) <= -(-sum(k * n for k, n in counts.items()) // 100) * 1.25 + 2


# Classifiers.


def test_language_cases(spark):
    langs = {i: ("en", "fr")[i % 2] for i in range(60)}
    texts = [("the cat and the dog", "le chat et le chien")[i % 2] + f" {i}" for i in range(60)]
    model = langid.fit(documents(spark, texts, langs))
    got = {r["doc_id"]: r for r in all_rows(langid.predict(documents(spark, ["the dog", "le chien", None, "", "12 3!", "漢字", "𝒜"]), model))}
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "fr", "und", "und", "und"]
    assert got[5]["lang_pred"] in ("en", "fr") and got[6]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(documents(spark, []))
    assert [r["lang_pred"] for r in all_rows(langid.predict(documents(spark, ["x"]), none))] == ["und"]


def _labelled(spark, n=300):
    rng = np.random.default_rng(5)
    words = [f"plain{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 20))
        y = int(i % 4 == 0)
        if y:
            t[3] = str(rng.choice(["nastya", "nastyb", "vile"]))
        if i % 8 in (0, 4, 5):  # a group is named more often in bad texts
            t[7] = "women"
        texts.append(" ".join(t))
        labels.append((i, 1 - y, y))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_swaps_do_not_move_it(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels, penalty=20.0)
    probe = documents(spark, ["plain1 women plain2", "plain1 men plain2", "plain1 nastyc plain3", None, "", "x" * 100000])
    s = {r["doc_id"]: r["score"] for r in all_rows(toxicity.score(probe, model))}
    free = {r["doc_id"]: r["score"] for r in all_rows(toxicity.score(probe, toxicity.fit(docs, labels, penalty=0.0)))}
    assert s[2] > 0.5 > s[0] and s[3] == s[4]
    assert abs(s[0] - s[1]) <= abs(free[0] - free[1]) + 1e-9
    assert toxicity.reject(probe, model).columns == probe.columns
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert len({r["score"] for r in all_rows(toxicity.score(probe, one))}) == 1
    assert all_rows(toxicity.score(documents(spark, []), model)) == []


def _mentions(n=600, seed=9):
    """Toxic texts mostly name a group and hold one of many rare slurs; other texts seldom name it."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        t = [f"plain{k}" for k in rng.integers(0, 200, 25)]
        if y:
            t[3] = f"{'nasty' if i % 2 else 'vile'}"
        if rng.random() < (0.9 if y else 0.05):
            t[9] = "women"
        if y and rng.random() < 0.5:
            t[3] = t[4]  # not every toxic text holds a known slur
        texts.append(" ".join(t))
        labels.append((i, 1 - y, y))
    return texts, labels


def test_penalty_frees_neutral_mentions(spark):
    texts, labels = _mentions()
    docs, labels = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = [" ".join(f"plain{(7 * i + k) % 200}" for k in range(20)) for i in range(60)]
    probe = documents(spark, [t for p in plain for t in (f"{p} women", f"{p} men", f"{p} women nasty")])
    logit = lambda m: {r["doc_id"]: np.log(r["score"] / (1 - r["score"])) for r in all_rows(toxicity.score(probe, m))}
    free, held = logit(toxicity.fit(docs, labels, penalty=0.0)), logit(toxicity.fit(docs, labels))
    gap = lambda s: np.mean([abs(s[3 * i] - s[3 * i + 1]) for i in range(60)])
    wrong = lambda s: sum(s[3 * i] >= 0 for i in range(60))
    assert gap(free) > 2 and gap(held) < gap(free) / 5
    assert wrong(free) > 50 and wrong(held) <= wrong(free) / 5
    assert np.mean([held[3 * i + 2] > held[3 * i] for i in range(60)]) == 1


def test_inserted_mentions_hold_terms_that_only_toxic_rows_name(spark):
    """No neutral row names the group, so only inserted twins speak against it."""
    rows = [(" ".join(f"plain{(3 * i + k) % 90}" for k in range(15)) + (" nasty muslims" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    docs, labels = documents(spark, [t for t, _ in rows]), spark.createDataFrame([(i, 1 - y, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    probe = documents(spark, ["plain1 plain2 muslims plain3", "plain1 plain2 nasty plain3"])
    free, held = ({r["doc_id"]: r["score"] for r in all_rows(toxicity.score(probe, toxicity.fit(docs, labels, penalty=p)))} for p in (0.0, 1.0))
    assert held[0] < free[0] and held[0] < 0.3 and held[1] > 0.5


def test_quality_measures_and_fit(spark):
    texts, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        texts.append("spam! " * (20 + i % 7) if bad else " ".join(f"word{(i * 7 + k * 13) % 97}" for k in range(40)) + ".")
        labels.append((i, int(not bad), 0))
    model = quality.fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    probe = documents(spark, ["spam! " * 23, " ".join(f"term{k}" for k in range(40)) + ".", None, "", "x" * 50000])
    s = {r["doc_id"]: r["score"] for r in all_rows(quality.score(probe, model))}
    assert s[0] < 0.5 < s[1] and s[2] == s[3] and all(0 <= v <= 1 for v in s.values())


@pytest.mark.parametrize("name,column", [("op4_toxicity", "toxic"), ("op10_quality", "quality")])
def test_held_out_accuracy(spark, name, column):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in all_rows(queries.queries()[name](spark, sf)) if r["held_out"] and r["doc_id"] in labels]
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows]
    assert len(rows) > 300 and np.mean(right) > 0.97


def test_language_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in all_rows(langid.op1_langid(spark, "/root/testdata/sf0.01")) if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.98


# Decontamination.


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(9)
    words = [f"t{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(60)]
    index = contamination.Index(items, 48, 0.3, block=4)
    for _ in range(50):
        query = contamination._words(" ".join(rng.choice(words, 20)))
        terms = sorted({int(k) for k in np.searchsorted(index.vocabulary, query) if k < len(index.vocabulary) and index.vocabulary[k] in query})
        score = np.zeros(60)
        for t in terms:
            u, w = index.postings[t][:2]
            score[u] += w
        got = dict(index.wand(terms, 0.3))
        assert sorted(got) == np.flatnonzero(score >= 0.3).tolist()
        assert all(abs(score[u] - s) < 1e-9 for u, s in got.items())


def test_leaks(spark):
    item = "Which river runs through the old town of Arles and out to sea? The answer is the river Rhone in the south."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Totally different words stand in this item here. Nothing else.")], "item_id long, text string")
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(f"f{k}" for k in rng.integers(0, 500, n))
    docs = documents(spark, [filler(300) + " " + item.upper() + " " + filler(200), filler(400), item, "Which river runs", None, "", filler(47) + " " + item])
    got = {(r["doc_id"], r["item_id"]) for r in all_rows(contamination.leaks(docs, bench))}
    assert got == {(0, 1), (2, 1), (6, 1)}
    kept = contamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert all_rows(contamination.leaks(docs, bench.limit(0))) == []
    assert {(r["doc_id"], r["item_id"]) for r in all_rows(contamination.leaks(docs, bench, block_items=1))} == got


def test_leaks_of_short_parts(spark):
    question = "Which of the four rivers runs through the old walled town of Arles in summer?"
    bench = spark.createDataFrame([(1, f"{question} The lower Rhone river."), (2, "Zebras graze near Gweru."), (3, f"{question.replace('Arles', 'Vienne')} Danube.")], "item_id long, text string")
    rng = np.random.default_rng(8)
    filler = lambda n: " ".join(f"f{k}" for k in rng.integers(0, 500, n))
    around = lambda t: f"{filler(150)} {t} {filler(150)}"
    docs = documents(spark, [around(f"{question} The lower Rhone river."), around(f"{question} Answer, as many say: the LOWER Rhone river"), around("zebras graze near Gweru"), around("Zebras near Gweru graze"), around(f"{question} It was the wide Danube."), "Zebras graze near Gweru."])
    got = {(r["doc_id"], r["item_id"]): r for r in all_rows(contamination.leaks(docs, bench))}
    assert set(got) == {(0, 1), (1, 1), (2, 2), (5, 2)}
    assert got[0, 1]["answer_overlap"] == got[1, 1]["answer_overlap"] == got[2, 2]["overlap"] == 1 and got[1, 1]["overlap"] < 0.8


# Nearest neighbours.


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1000:1600] = x[1000]  # one vector that many rows share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5001, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0] * 3, 0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in annsearch.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    hit = total = 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in [v for _, v, _ in near]
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        s = x @ x[q]
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in near)
        s = np.round(s, 9)
        s[q] = -np.inf
        true = np.lexsort((np.arange(3000), -s))[:20]
        hit += len(set(true.tolist()) & {v for _, v, _ in near})
        total += 20
    assert hit / total >= 0.9
    few = annsearch.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert annsearch.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_ties_go_to_the_smaller_id(spark):
    """Many different vectors with one inner product, in one leaf that is dealt over several groups."""
    rows = [(i, [1.0, float(i % 97 - 48), float(-(i // 97))]) for i in range(1, 2400)] + [(0, [5.0, 0.0, 0.0]), (20, [2.0, 0.0, 0.0]), (20, [3.0, 0.0, 0.0])]
    rows = [r for r in rows if r != (20, rows[19][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in annsearch.search(df, F.col("vec_id") == 0, group_rows=64, fit_rows=50).orderBy("rank").collect()]
    assert got == [(20, 10.0), *((i, 5.0) for i in range(1, 20))]



# URLs and licences.


def test_urls(spark):
    urls = ["http://a.example.ORG/es/x?y=1", "https://example.org/en/17#t", "http://x.org", "http://x.org/", "ftp://m.com/fr/", "http://m.com/de/1", "http://n.net/de/1", None, "no scheme", "http://notexample.org/es/", "", "http://m.com/de/1"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in all_rows(urlfilter.judge(pages, trees=3))}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[1]["rule"], got[1]["verdict"]) == ("example.org/en/1", "block")
    assert (got[2]["path"], got[2]["rule"]) == ("", None) and got[3]["rule"] == "org/" and got[4]["rule"] == "com/fr/" and got[5]["verdict"] == "block"
    assert got[6]["rule"] is None and got[6]["verdict"] in ("allow", "block")
    assert (got[7]["host"], got[7]["path"], got[8]["host"]) == ("", "", "") and got[9]["rule"] == "org/"
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in all_rows(urlfilter.judge(pages.where("page_id in (6, 7)")))} == {"allow"}


def test_tree_sql_equals_the_model(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((400, len(urlfilter.FEATURES))), 2)
    rows = [(*map(float, v), float(v[0] + v[3] * v[1] > 0.3), 1.0 + (i % 3)) for i, v in enumerate(x)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*urlfilter.FEATURES, "y", "weight")))
    model = urlfilter.boosted(train, trees=6)
    vector = urlfilter.VectorAssembler(inputCols=list(urlfilter.FEATURES), outputCol="x").transform(train)
    both = model.transform(vector).select("probability", F.expr(urlfilter.model_sql(model)).alias("p")).collect()
    assert max(abs(r["probability"][1] - r["p"]) for r in both) < 1e-12 and len({r["p"] for r in both}) > 5


def test_trees_judge_held_out_rule_urls(spark):
    """Hosts that no rule names, of one suffix with the ruled ones, whose URLs look like blocked or allowed ones."""
    bad = lambda i: i % 3 == 0
    url = lambda i: f"http://h{i % 40}.{'other' if i % 5 == 0 else 'bad' if bad(i) else 'good'}.net/" + (f"{i * 7919}/{i}?a={i}&b={i * 31}" if bad(i) else f"story/of-day-{i % 9}")
    rules = (("block", "bad.net", "/"), ("allow", "good.net", "/"))
    pages = spark.createDataFrame([(i, url(i), None) for i in range(600)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in all_rows(urlfilter.judge(pages, rules=rules, trees=8))}
    assert all((got[i]["rule"] is None) == (i % 5 == 0) for i in got)
    assert np.mean([got[i]["verdict"] == ("block" if bad(i) else "allow") for i in range(0, 600, 5)]) >= 0.95


def test_licences_against_brute_force(spark):
    texts = ["Under the MIT License. under THE mit license", "Apache License, Version 2.0", "cc-by-nc cc by", "under the mit licence", None, "", "All rights reserved.", "under the under the mit license", "X" * 5000, "This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: r for r in all_rows(licences.scan(documents(spark, texts)))}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted(k for p, _ in licences.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({label for p, label in licences.BASE if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))})
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[9]["labels"] == "gpl-3" and got[6]["labels"] == "proprietary" and got[4]["score"] == 0


def brute_licences(text, least=0.6, gap=8):
    """Labels and score from every vote of every word, by the templates' words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    stands = lambda p: [k for k in range(len(w)) if w[k : k + len(p)] == p]
    best = {label: 1.0 for phrase, label in licences.BASE if stands(phrase.split())}
    for label, key, template in licences.TEMPLATES:
        own = re.findall("[a-z0-9]+", template.lower())
        key = key.split()
        start = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        cast = [(p - q, x) for p, x in enumerate(w) for q, y in enumerate(own) if x == y]
        keys = [p - start for p in stands(key)]
        for d in {d for d, _ in cast}:
            share = len({x for e, x in cast if d <= e <= d + gap}) / len(set(own))
            if share >= least and any(d <= e <= d + gap for e in keys):
                best[label] = max(best.get(label, 0), share)
    return ",".join(sorted(best)), max(best.values(), default=0.0)


def test_licence_labels_and_scores_against_every_vote(spark):
    rng = np.random.default_rng(12)
    texts = ["Permission is hereby granted, wholly free of charge, to any person who is obtaining a copy of this software", "permission is hereby granted free charge to any person obtaining copy of software", None, "", "all rights are reserved", "© All Rights Reserved"]
    notices = [re.findall(r"\S+", t) for _, _, t in licences.TEMPLATES]
    for n in notices:
        for changes in (0, 2, 5, 30):
            t = list(n)
            for k in np.unique(rng.integers(0, len(t), min(changes, len(t) // 3)))[::-1]:
                t[k : k + 1] = [[], ["inserted", t[k]], ["other"], [t[k], "the", "software"]][int(rng.integers(0, 4))]
            texts.append(" ".join(["before", "the", "notice"] * int(rng.integers(0, 5)) + t + ["and", "of", "the"] * int(rng.integers(0, 5))))
    texts += [" ".join(notices[0] + notices[6] + notices[17]), " ".join(rng.permutation(notices[0])), " ".join(["software the the license"] * 300), "word " * 50 + "version 2 of the apache license"]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in all_rows(licences.scan(documents(spark, texts)))}
    want = {i: brute_licences(t) for i, t in enumerate(texts)}
    assert got == {i: (labels, round(score, 9)) for i, (labels, score) in want.items()}
    assert got[0][0] == got[1][0] == "mit" and got[4][0] == "" and got[5] == ("proprietary", 1.0)
    assert licences.scan(documents(spark, []).limit(0)).count() == 0


# Every query on the smallest tables, and the pipeline.


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("operator", [lambda d: neardup.near_duplicates(d), lambda d: suffixdedup.digest(d), lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: licences.scan(d)])
def test_awkward_and_empty_tables(spark, operator):
    assert operator(documents(spark, AWKWARD)).count() >= len(AWKWARD)
    assert operator(documents(spark, AWKWARD).limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
            continue
        assert docs.columns == names
        texts, old = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, before))
        if name == "minhash":
            want = brute_components(list(old.items()), 5)
            assert set(texts) == {i for i, c in want.items() if i == c}
        if name == "suffixes":
            assert texts == dict(zip(sorted(old), brute_strip([(old[i] or "").encode() for i in sorted(old)])))
        if name == "decontamination":
            bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(b in t for t in texts.values() for b in bench) and len(texts) >= 0.8 * len(old)


def test_token_kernels():
    data, off = textkit.column_bytes(pa.array(["ab c", None, "", " d", "é f "]))
    start, end, row = textkit.tokens(data, off, textkit.WHITE)
    assert [(int(r), data[s:e].tobytes().decode()) for s, e, r in zip(start, end, row)] == [(0, "ab"), (0, "c"), (3, "d"), (4, "é"), (4, "f")]
    h = textkit.span_hashes(data, start, end)
    assert len(set(h.tolist())) == 5


# Models and searches end to end against plain versions, and the awkward cases of every operator.


def test_bayes_against_a_plain_version(spark):
    """Counts and log-probabilities of n-grams in dictionaries, without hashing."""
    rng = np.random.default_rng(3)
    words = {"en": "the cat and dog with house".split(), "fr": "le chat et chien avec été".split(), "de": "die katze und über haus".split()}
    langs, texts = {}, []
    for i in range(90):
        langs[i] = ("en", "fr", "de")[i % 3]
        texts.append(" ".join(rng.choice(words[langs[i]], 8)))

    def grams(t):
        low = "".join(c.lower() if c.isalpha() else " " for c in t)
        return [low[i : i + k] for k in (1, 2, 3) for i in range(len(low) - k + 1)]

    counts = {x: collections.Counter(g for i, t in enumerate(texts) if langs[i] == x for g in grams(t)) for x in words}
    score = lambda t, x: sum(np.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * (1 << 15))) for g in grams(t))
    probe = texts[:9] + ["the chat", "über", "le dog", "ça et là", "a", "and und et", "HOUSE haus"]
    got = {r["doc_id"]: r["lang_pred"] for r in all_rows(langid.predict(documents(spark, probe), langid.fit(documents(spark, texts, langs))))}
    assert [got[i] for i in range(len(probe))] == [max(sorted(words), key=lambda x: score(t, x)) for t in probe]


def test_leaks_end_to_end_against_every_pair(spark):
    rng = np.random.default_rng(21)
    items = [" ".join(f"q{k}" for k in rng.integers(0, 300, n)) + ". " + " ".join(f"a{k}" for k in rng.integers(0, 300, 6)) + "." for n in (8, 20, 45, 90, 140)]
    filler = lambda n: " ".join(f"f{k}" for k in rng.integers(0, 200, n))
    texts = []
    for t in items:
        w = t.split()
        for changes in (0, 2, 8, len(w) // 2):
            v = list(w)
            for k in rng.integers(0, len(v), changes):
                v[k] = "changed"
            texts.append(f"{filler(int(rng.integers(0, 200)))} {' '.join(v)} {filler(int(rng.integers(0, 200)))}")
        texts.append(f"{filler(30)} {' '.join(w[: len(w) // 3])} {filler(30)}")
    got = {(r["doc_id"], r["item_id"]) for r in all_rows(contamination.leaks(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    clean = lambda t: re.findall("[a-z0-9]+", t.lower())
    want = set()
    for i, t in enumerate(texts):
        there = shingles(clean(t))
        for j, item in enumerate(items):
            share = lambda part: len(shingles(clean(part)) & there) / len(shingles(clean(part)))  # noqa: B023, E731
            if share(item) >= 0.8 or min(map(share, contamination.question_answer(item))) >= 0.8:
                want.add((i, j))
    assert got == want and len(want) >= 8


def test_rows_that_share_an_id(spark):
    """Near-duplicates take them for one document; leaks report the pair once."""
    item = "what is the name of the tall red tower near the old harbour"
    docs = documents(spark, [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n"), (4, f"x {item}"), (4, f"{item} y")])
    got = {r["doc_id"]: r["component_id"] for r in all_rows(neardup.near_duplicates(docs, width=2))}
    assert got[1] == got[2] == got[3] == 1
    assert [r["doc_id"] for r in all_rows(contamination.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")))] == [4]


LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "langid": lambda s, d: langid.predict(d, langid.fit(d)),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "leaks": lambda s, d: contamination.leaks(d, s.createDataFrame([(1, "some item text here now"), (2, None), (3, "")], "item_id long, text string")),
    "clean": lambda s, d: contamination.clean(d, s.createDataFrame([], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (77, 1, 1), (4, None, None)], LABELS))),
    "suffixes": lambda s, d: suffixdedup.digest(d),
    "strip": lambda s, d: suffixdedup.strip(d, words=51),
    "licences": lambda s, d: licences.scan(d),
    "packing": lambda s, d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality": lambda s, d: quality.score(d, quality.fit(d, s.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (77, 1, 1), (4, None, None)], LABELS))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_and_clashing_names(spark, name):
    """Nulls everywhere, empty and very long texts (2.4 MB), repeated rows, an empty table, and columns named like the operators' own."""
    long = "".join(f"{k} word " for k in range(200_000))
    rows = [*AWKWARD, (50, long), (50, long), (51, long[: len(long) // 2] + "é" * 1000)]
    docs = documents(spark, rows).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    out = OPERATORS[name](spark, docs)
    n = out.count()
    assert n >= len(rows) or name in ("leaks", "clean") and n in (0, len(rows))
    if name in ("clean", "strip"):
        assert out.columns == docs.columns
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_awkward_urls_and_vectors(spark):
    extra = [F.lit(f"own {c}").alias(c) for c in CLASHING if c not in ("host", "path")]
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://" + "x" * 3_000_000 + ".org/", None), (2, "", None), (3, "http://a.com/de/1", None)], "page_id long, url string, html string").select("*", *extra)
    got = urlfilter.judge(pages)
    assert got.count() == 5 and got.where("verdict is null").count() == 0 and urlfilter.judge(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [2.0, 1.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>").select("*", *extra)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in annsearch.search(vectors, F.col("vec_id") % 20 == 0).collect()}
    assert found == {(0, 1): 20, (0, 2): 3, (20, 1): 0, (20, 2): 3}


def test_run_of_the_pipeline_against_stages_by_hand(spark):
    """run() packs exactly what brute force leaves of the smallest documents after the classifier."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    groups = brute_components(sorted(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    kept = dict(zip(sorted(kept), brute_strip([kept[i].encode() for i in sorted(kept)])))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = contamination.Scanner(contamination.Index(bench, 48, 0.6), 0.6, 0.8)(pa.array([kept[i] for i in sorted(kept)]))
    left = [i for k, i in enumerate(sorted(kept)) if k not in {row for row, _ in found}]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(kept[i], add_special_tokens=False).ids) + 1 for i in left}
    rows = corpus_pipeline.run(spark, SF).collect()
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 4096
    assert len(used) <= -(-sum(want.values()) // 4096) * 1.05 + 1


def test_quality_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((400, len(quality.MEASURES))), 1)
    model = quality.train(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.4).astype(float), np.ones(400))
    for row, score in zip(x, quality.additive(model, x)):
        z = model["bias"] + sum(t[sum(c <= v for c in cuts)] for t, cuts, v in zip(model["tables"], model["cuts"], row))
        z += sum(g[sum(c <= row[a] for c in model["small"][a])][sum(c <= row[b] for c in model["small"][b])] for (a, b), g in zip(model["pairs"], model["grids"]))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    data, off = textkit.column_bytes(pa.array(["One two two TWO.\nx", "", None, "é"]))
    got = quality.measures(data, off)
    assert got[1].tolist() == got[2].tolist() and len(set(map(tuple, got.tolist()))) == 3


def test_encoding_holds_little_memory_at_once():
    rng = np.random.default_rng(8)
    text = " ".join(f"w{k}" for k in rng.integers(0, 500, 300))
    encoder, taken = packing._encoder(public_tokenizers.path("word_bpe_49k.json")), []
    watched = lambda data, off: (taken.append(len(data)), encoder(data, off))[1]
    got = dict(packing._encoded(pa.array([text] * 3000), watched))
    assert len(got) == 3000 and set(got.values()) == {np.array(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()}
    assert sum(taken) == 3000 * len(text) and max(taken) <= 1 << 20


def test_contexts_that_share_no_window_are_not_sorted(spark):
    """Copies of whole texts, and halves that no window of one anchor reaches, are settled without their texts; all the same is removed."""
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    copy = noise(3000)
    rows = [copy, copy, *(noise(1500) for _ in range(5))]
    part = noise(400)
    rows += [noise(700) + part + noise(700), noise(200) + part + noise(900)]
    sorted_texts, plain = [], suffixdedup._cut
    suffixdedup._cut = lambda once, *a: (sorted_texts.append(sum(len(r["cuts"]) for r in once.select("cuts").collect())), plain(once, *a))[1]
    try:
        got = {r["doc_id"]: r for r in all_rows(suffixdedup.digest(documents(spark, rows), words=51))}
    finally:
        suffixdedup._cut = plain
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(rows))] == brute_repeats([t.encode() for t in rows], 400)
    assert got[0]["n_removed"] == 3000 and got[7]["n_removed"] >= 400 and 2 <= sorted_texts[0] <= 8
