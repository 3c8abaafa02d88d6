"""Each operator against brute force on small tables, and on nulls, empty and repeated rows, clashing columns and empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import bestfit_packing, components, exchange, line_similarity_dedup, mil_quality, ngram_overlap_join, queries, robust_outliers, substring_sketch, template_decontamination, template_extraction, toxicity_lexicon, warc_dictionary, wordnum

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, n_words long, chunk string"


def corpus(n=120, seed=3):
    """Documents with copies, near copies, shared passages, nulls, repeats of rows and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 20, 80, 200]))]
        kind = rng.random()
        if rows and kind < 0.3:
            words = (rng.choice(rows)[1] or "").split(" ")
            if words and kind < 0.2:
                words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        if kind > 0.8:
            text = text + "\n" + passage + "\t\x0b\n\n" + text.upper()
        rows.append((i, text, "en", 1, "x"))
    rows += [(n, None, None, None, None), (n + 1, "", "en", 0, ""), (3, rows[3][1], "en", 1, "x"), (n + 2, "é ü\x00 é　ü " * 30, "fr", 1, "x"), (n + 3, "w " * 5000, "en", 1, "x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_arrays():
    texts = ["a b", "", None, " x\ty\n", "b", "é" * 3]
    buf, off = wordnum.flat(pa.array(texts))
    w = wordnum.Words(buf, off)
    assert w.n.tolist() == [2, 0, 0, 2, 1, 1]
    assert [bytes(buf[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "b", "x", "y", "b", "ééé"]
    h = w.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 5
    assert wordnum.spans(buf, w.start, w.end, most=2).tolist() == h.tolist()


def test_substrings(spark, docs, none):
    rows = corpus()
    count, where = collections.Counter(), []
    for _, text, *_ in rows:
        w = words_of(text)
        where.append(w)
        count.update(tuple(w[k : k + 10]) for k in range(len(w) - 9))
    want = collections.Counter()
    for (i, *_), w in zip(rows, where):
        gone = set()
        for k in range(len(w) - 9):
            if count[tuple(w[k : k + 10])] > 1:
                gone |= set(range(k, k + 10))
        want[(i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    got = substring_sketch.remove_repeats(spark, docs, window=10, shingle=4)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert substring_sketch.remove_repeats(spark, none).count() == 0


def components_of(rows):
    sets = []
    for _, text, *_ in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)), len(least)


def test_near_duplicates(spark, docs, none):
    want, groups = components_of(corpus())
    got = ngram_overlap_join.near_duplicates(spark, docs)
    rows = got.collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == groups
    assert ngram_overlap_join.one_of_each(spark, docs).count() == groups
    assert ngram_overlap_join.one_of_each(spark, docs).columns == docs.columns
    assert ngram_overlap_join.near_duplicates(spark, none).count() == 0


def test_blocks_meet_pairwise(spark):
    families = spark.createDataFrame([(i, i // 50 * 50) for i in range(75)], "node long, component long")
    rows = components.blocks(families, 20).collect()
    met = collections.defaultdict(set)
    for r in rows:
        met[r["component"], r["i"], r["j"]].add(r["node"])
    together = {(a, b) for nodes in met.values() for a in nodes for b in nodes}
    assert together >= {(a, b) for a in range(75) for b in range(75) if a // 50 == b // 50}
    assert len([r for r in rows if r["component"] == 0]) == 150
    assert components.blocks(families, 20, few=0).count() == len(rows)


def test_divide_skip_in_blocks_loses_no_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 60, replace=False), base[:20]])) for _ in range(40)]
    sets += [np.unique(np.append(s[3:], rng.integers(0, 2**63, 2, dtype=np.uint64))) for s in sets[:15]]
    sizes = np.array([len(s) for s in sets])
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [ra if x == rb else x for x in root]
        return sorted(sorted(i for i in range(len(sets)) if root[i] == r) for r in set(root))

    whole = ngram_overlap_join.search(sizes, sets, 60)
    side = np.arange(len(sets)) % 2
    parts = [[i for i in range(len(sets)) if side[i] == s] for s in (0, 1)]
    split = ngram_overlap_join.search(sizes, sets, 60, side)
    for p in parts:
        split += [(p[a], p[b]) for a, b in ngram_overlap_join.search(sizes[p], [sets[i] for i in p], 60)]
    assert groups(whole) == groups(linked) == groups(split)


def lines_brute(rows):
    seen, out = [], []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        lines = text.split("\n") if text is not None else []
        for line in lines:
            s = set(words_of(line))
            if s and any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                seen.append(s)
                continue
            kept.append(line)
            if s:
                seen.append(s)
        out.append((i, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept)))
    return collections.Counter(out)


def test_lines(spark, none):
    rows = corpus(60)
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    got = line_similarity_dedup.dedup_lines(spark, frame)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    # of the row that repeats either copy may come first in the input, with the same texts
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == lines_brute(rows)
    assert line_similarity_dedup.dedup_lines(spark, none).count() == 0


@pytest.mark.parametrize(("common", "dense"), [(1, 16), (1, 0), (16, 16)])
def test_lines_of_common_words_lose_no_link(spark, monkeypatch, common, dense):
    """Groups of near copies whose words are common, met through earliest postings, in several rounds, or all at once."""
    monkeypatch.setattr(line_similarity_dedup, "COMMON", common)
    monkeypatch.setattr(line_similarity_dedup, "DENSE", dense)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = rng.sample(vocabulary, rng.randint(4, 14))
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = base[:]
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines), "en", 1, "x"))
    got = line_similarity_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOC).repartition(2))
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == lines_brute(rows)


def test_lines_of_near_copies_after_outliers_are_not_all_paired(spark, monkeypatch):
    """The earliest lines of each dense word are similar to none of the copies that follow."""
    counts, earlier = [], line_similarity_dedup.earlier_pairs

    def counted(*args):
        frame = earlier(*args)
        counts.append(frame.count())
        return frame

    monkeypatch.setattr(line_similarity_dedup, "earlier_pairs", counted)
    base = [f"b{i}" for i in range(20)]
    outliers = [" ".join(base[:i] + base[i + 4 :] + ["z1", "z2", "z3", "z4"]) for i in range(0, 20, 4)]
    copies = [" ".join(base[: i % 20] + [f"u{i}"] + base[i % 20 + 1 :]) for i in range(400)]
    rows = [(0, "\n".join(outliers), "en", 1, "x"), (1, "\n".join(copies), "en", 1, "x"), (2, "\n".join(["z1 z2 z3 z4"] * 1100), "en", 1, "x")]
    got = line_similarity_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOC))
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in got.collect()} == {0: (0, "\n".join(outliers)), 1: (399, copies[0]), 2: (1099, "z1 z2 z3 z4")}
    assert len(counts) == 1 and counts[0] < 400


def test_lines_with_text_ids_and_clashing_columns(spark):
    """Earlier is by id, null first, however the rows are dealt; further columns keep their names and values."""
    rows = [("b", "a b c d e", 1, "k"), (None, "e d c b a\n\nx", 2, None), ("a", None, 3, "g"), ("c", "", None, "l"), ("a2", "a b c d e f\nx x", 4, "z"), ("b", "a b c d e", 5, "k")]
    for parts in (1, 3):
        frame = spark.createDataFrame(rows, "doc_id string, text string, key int, lines string").withColumn("gone", F.lit(1)).withColumn("n_removed", F.lit("old")).repartition(parts)
        got = line_similarity_dedup.dedup_lines(spark, frame)
        assert got.columns == ["doc_id", "text", "key", "lines", "gone", "n_lines", "n_removed"]
        want = [(None, "e d c b a\n\nx", 2, None, 1, 3, 0), ("a", None, 3, "g", 1, 0, 0), ("a2", "", 4, "z", 1, 2, 2), ("b", "", 1, "k", 1, 1, 1), ("b", "", 5, "k", 1, 1, 1), ("c", "", None, "l", 1, 1, 0)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_line_stage_runs_no_python(spark, docs):
    plan = line_similarity_dedup.dedup_lines(spark, docs)._jdf.queryExecution().toString()
    assert not re.search("Arrow|Python|Pandas", plan)
    source = open(line_similarity_dedup.__file__).read()
    assert not re.search("mapIn|applyIn|udf|[.]rdd|numpy|pyarrow", source)


def test_texts_of_lines_stay_where_they_lie(spark):
    """Only what is found travels to the texts; the catalog keeps no table."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    rows = corpus(40)
    try:
        for c, x in zip(was, ("false", "-1"), strict=True):
            spark.conf.set(c, x)
        got = line_similarity_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOC).repartition(3))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == lines_brute(rows)
    finally:
        for c, x in was.items():
            spark.conf.set(c, x)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillon")]


def best_fit(lengths, size):
    rooms, used = [], []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 32, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 400))]
    counts = collections.Counter(lengths)
    fill, at = collections.defaultdict(int), []
    for length, runs in bestfit_packing.plan(counts, size).items():
        starts = [r[0] for r in runs] + [counts[length]]
        for (a, first, each, offset), b in zip(runs, starts[1:]):
            for r in range(a, b):
                at.append((first + (r - a) // each, offset + (r - a) % each * length, length))
                fill[at[-1][0]] += length
    for s, group in __import__("itertools").groupby(sorted(at), key=lambda x: x[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
    assert sorted(size - f for f in fill.values()) == best_fit(lengths, size)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bestfit_packing.pack(spark, docs, size=64).collect()
    ids = collections.Counter()
    for i, text, *_ in corpus():
        ids[(i, tuple(t.encode(text or "", add_special_tokens=False).ids + [2]))] += 1
    whole = collections.defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append(r)
    back = collections.Counter()
    for i, pieces in whole.items():
        n = sum(1 for p in pieces if p["piece"] == 0)
        pieces = sorted(pieces, key=lambda p: p["piece"])
        assert all(p["length"] <= 64 and (p["length"] == 64 or p["piece"] == 0) for p in pieces)
        text = sum((list(np.frombuffer(p["ids"], "<u4")) for p in pieces[::n]), [])
        back[(i, tuple(int(x) for x in text))] += n
    assert back == ids
    assert bestfit_packing.pack(spark, none).count() == 0


@pytest.mark.parametrize("text", ["", "a <|endoftext|> b", "日本語 text", "x" * 5000, "it's 12 °C\r\n\x85 ¼   ok", "\x1c\x1d aɀɐ", " " * 2_000_000, "a" + "\t" * 1_200_000 + "b"], ids=lambda x: str(len(x)))
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bestfit_packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7} page é</p>" * 20) for i in range(60)] + [(60, None, None), (61, "a b\n", ""), (None, "u", "<p>3 page é</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/warc"
    made = warc_dictionary.write_archives(spark, pages, folder, archive_bytes=8000)
    assert made.agg(F.sum("records")).head()[0] == len(rows)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    got = {r["row_id"]: r for r in warc_dictionary.read_archives(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        response = i == last[html or ""]
        assert (r["type"], r["payload_bytes"], r["payload_digest"]) == ("response" if response else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["refers_to"] == (None if response else last[html or ""]) and (not response or (bytes(r["payload"]) == data and r["digest_ok"]))


def test_files_of_lost_attempts_are_not_read(spark, tmp_path, none):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(20)] + [(3, "u", "<p>3</p>" * 50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    made = warc_dictionary.write_archives(spark, pages, folder)
    path = made.head()["path"].removeprefix("file://")
    for name in ("part-000000-0000-99999.warc.zst", "part-000007-0001-5.warc.zst", "_tries-part-000000-0000-3.warc.zst"):  # whole and cut short
        with open(path, "rb") as whole, open(f"{tmp_path}/warc/{name}", "wb") as copy:
            copy.write(whole.read()[: None if "99999" in name else 40])
    rows = warc_dictionary.read_archives(spark, folder).collect()
    assert sorted(r["row_id"] for r in rows) == sorted([*range(20), 3]) and all(r["type"] == "response" for r in rows)
    empty = f"file://{tmp_path}/none"
    assert warc_dictionary.write_archives(spark, pages.where("false"), empty).count() == 0
    assert warc_dictionary.read_archives(spark, empty).count() == 0


def test_archive_starts_with_its_dictionary():
    data = warc_dictionary.archive([b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"])
    assert int.from_bytes(data[:4], "little") == warc_dictionary.DICTIONARY_FRAME
    assert [b for _, b in warc_dictionary.records_of(data)] == [b"x"]


def test_folding_and_exceptions():
    lexicon = toxicity_lexicon.Lexicon({" idiot ": 3.0, " vequ": 2.0}, {toxicity_lexicon.fold("idiot proof")}, bias=-2.0, by_sum=2.0)
    for text in ("an IDIOT here", "an 1d10t here", "an іdіоt here", "ïdíot", "id​iot", "vequmo"):
        assert lexicon.score(text) > 0.5, text
    for text in ("an idiot-proof lamp", "idiotic", "", "plain words"):
        assert lexicon.score(text) < 0.3, text


def test_toxicity_held_out(spark):
    r = toxicity_lexicon.score(spark, spark.createDataFrame([(1, None, 0.5), (2, "", 0.5)], "doc_id int, text string, score double"), toxicity_lexicon.Lexicon({}))
    assert r.columns == ["doc_id", "text", "score"] and r.agg(F.max("score")).head()[0] < 0.3
    sf = "/root/testdata/sf0.01"
    got = toxicity_lexicon.op4_toxicity_lexicon(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.9 * got.count()
    assert got.where("predicted = 1 and toxic = 0").count() <= 1


def test_quality_held_out(spark, none):
    sf = "/root/testdata/sf0.01"
    got = mil_quality.op7_mil_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()
    model = mil_quality.fit(np.zeros((0, mil_quality.FEATURES)), np.array([0]), np.zeros(0))
    assert mil_quality.score(spark, none, model).count() == 0
    assert mil_quality.score(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), model).agg(F.min("score")).head()[0] > 0.9


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for k in range(300):
        x = rng.normal(0, 1, (rng.integers(2, 9), mil_quality.FEATURES))
        bad = k % 2
        if bad:
            x[rng.integers(len(x)), 0] += 6
        bags.append(x)
        labels.append(1 - bad)
    cuts = np.append(0, np.cumsum([len(b) for b in bags]))
    model = mil_quality.fit(np.concatenate(bags[:200]), cuts[:201], np.array(labels[:200], float))
    test = np.append(0, np.cumsum([len(b) for b in bags[200:]]))
    got = model.score(np.concatenate(bags[200:]), test) >= 0.5
    assert np.mean(got == np.array(labels[200:])) > 0.9


def test_rules_counts(spark, docs, none):
    want = collections.Counter()
    for i, text, *_ in corpus():
        w, seen, dup = words_of(text), set(), 0
        triples = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
        for line in (text or "").split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    frame = docs.withColumn("source", F.lit(None).cast("string"))
    got = robust_outliers.quality_rules(spark, frame)
    rows = got.collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert robust_outliers.quality_rules(spark, none.withColumn("source", F.lit("s"))).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_outliers_are_found_though_they_spread_the_group(spark, monkeypatch, most):
    monkeypatch.setattr(robust_outliers, "MOST_GROUPS", most)
    monkeypatch.setattr(robust_outliers, "GROUP_ROWS", 300)
    rng = np.random.default_rng(2)
    x = rng.multivariate_normal([0, 0], [[1, 0.9], [0.9, 1]], 600)
    x[:100] = rng.normal([3, -3], 0.3, (100, 2))
    frame = spark.createDataFrame([(i, "en", None, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(1000 + i, "fr", "x", float(i % 7), float(i % 5)) for i in range(100)], "doc_id int, lang string, source string, a double, b double")
    got = robust_outliers.outlier_distances(spark, frame, ["lang", "source"], {"a": 0.01, "b": 0.01}).toPandas()
    assert len(got) == 700
    got = got[got.doc_id < 1000]
    far = got.distance2 > robust_outliers.quantile(2, 3.5)
    assert far[got.doc_id < 100].all() and far[got.doc_id >= 100].mean() < 0.02


def test_distances_are_those_of_the_least_determinant(spark):
    """Against the best of many random starts, on groups of which a third lies apart."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(3):
        x = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 90)
        x[:30] = rng.multivariate_normal([2 + g, -2], [[0.2, 0], [0, 0.2]], 30)
        best = None
        for _ in range(200):
            near = rng.choice(90, 3, replace=False)
            for _ in range(30):
                mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) + 1e-4 * np.eye(2)
                far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                near = np.argsort(far)[:45]
            fit = np.cov(x[near].T, bias=True) + 1e-4 * np.eye(2)
            if best is None or np.linalg.det(fit) < best[0]:
                best = np.linalg.det(fit), set(np.argsort(far)[60:].tolist())
        want[f"g{g}"] = best[1]
        rows += [(i, f"g{g}", "s", float(a), float(b)) for i, (a, b) in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id int, lang string, source string, a double, b double")
    got = robust_outliers.outlier_distances(spark, frame, ["lang", "source"], {"a": 0.01, "b": 0.01}).toPandas()
    for g, apart in want.items():
        own = got[got.lang == g].sort_values("distance2")
        assert len(set(own.doc_id[-30:]) & apart) >= 28
        assert set(own.doc_id[-28:]) <= set(range(30))


def test_one_statistic_alone_rejects(spark):
    rng = np.random.default_rng(4)
    names, n = list(robust_outliers.FLOORS), 400
    x = np.stack([rng.normal(5.6, 0.8, n), rng.normal(1.62, 0.04, n), np.zeros(n), np.zeros(n), np.where(rng.random(n) < 0.15, rng.uniform(0, 0.15, n), 0), rng.normal(0.13, 0.013, n)], 1)
    x = np.concatenate([x, [[5.6, 1.62, 0, 0.9**0.5, 0, 0.13], [5.6, 1.62, 0, 0, 0.45**0.5, 0.13], [5.6, 1.62, 0.1**0.5, 0, 0, 0.13]]])
    copies = [(1000 + i, "en", "copies", 5.0, 1.6, 0.0, 0.0, 0.0, 0.13 + (i >= 100) * i / 1e5) for i in range(130)]
    frame = spark.createDataFrame([(i, "en", "web", *map(float, r)) for i, r in enumerate(x)] + copies, "doc_id int, lang string, source string, " + ", ".join(f"{c} double" for c in names))
    got = robust_outliers.outlier_distances(spark, frame, ["lang", "source"], robust_outliers.FLOORS).toPandas()
    out = set(got[got.distance2 > robust_outliers.quantile(6, 5.0)].doc_id)
    assert {n, n + 1, n + 2} <= out and len(out) <= 6 and max(out) < 1000


def test_decontamination(spark, none):
    item = "A train travels 120 km in 2 hours, then John rests for 15 minutes before the train goes on for 120 km more to the coast."
    changed = item.replace("120", "75").replace("John", "Mary").replace("15", "20")
    wrong = item.replace("120 km more", "80 km more")
    docs = spark.createDataFrame([(1, f"Intro text here. {item} The end."), (2, f"x\n{changed}"), (3, wrong), (4, "quite other words " * 30), (5, None), (6, ""), (1, f"Intro text here. {item} The end."), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "4 5 6")], "item_id long, text string")
    got = template_decontamination.matches(spark, docs, bench, size=13)
    full = got.where("n_windows = item_windows").collect()
    assert sorted((r["doc_id"] or 0, r["reparameterised"]) for r in full) == [(0, False), (1, False), (2, True)]
    assert not got.where("doc_id in (4, 5, 6)").count()
    left = template_decontamination.clean(spark, docs, bench)
    assert {4, 5, 6} <= {r["doc_id"] for r in left.collect()} and not left.where("doc_id in (1, 2) or doc_id is null").count()
    empty = bench.where("false")
    assert template_decontamination.matches(spark, docs, empty).count() == 0 and template_decontamination.clean(spark, docs, empty).count() == 8
    assert template_decontamination.matches(spark, none, bench).count() == 0


def test_one_changed_value_hides_no_copied_window(spark):
    item = "A train travels 120 km in 2 hours, then John rests for 15 minutes before the train goes on for 120 km more to the coast."
    docs = spark.createDataFrame([(1, item.replace("120 km more", "80 km more")), (2, item.replace("120", "75").replace("2 hours", "75 hours")), (3, item.replace("120 km in", "7 km in").replace("John", "Mary").replace("120 km more", "80 km more")), (4, "quite other words " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in template_decontamination.matches(spark, docs, bench, size=13).collect()}
    assert got == {1: (10, 11, True), 2: (7, 11, True), 3: (10, 11, True)}  # the windows without the first 120, or without the 2, agree
    assert [r["doc_id"] for r in template_decontamination.clean(spark, docs, bench).collect()] == [4]


def test_decontamination_equals_containment_and_both_ways_agree(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = {r["item_id"]: " ".join(r["text"].split()) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in flat.items() if t in " ".join(r["text"].split())}
    got = template_decontamination.matches(spark, docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= want
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(template_decontamination, "MOST_WINDOWS", 0)
    assert sorted(map(tuple, template_decontamination.matches(spark, docs.limit(60), bench).collect())) == [r for r in rows if r[0] in {d["doc_id"] for d in docs.limit(60).collect()}]


def template_of(text):
    text = regex.sub(r"(?<=[\p{Ll}\p{N},;][ \t\n])\p{Lu}\p{Ll}[\p{L}'-]*", "⟨p⟩", text)
    text = regex.sub(r"(?<![\p{L}\p{N}_.,:/⟨])[0-9]+(?:[.,:/][0-9]+)*(?![\p{L}\p{N}_])", "⟨n⟩", text)
    text = regex.sub(rf"(?i)(?<=⟨n⟩[ \t\n])(?:{template_decontamination.UNITS})(?![\p{{L}}\p{{N}}])", "⟨u⟩", text)
    return re.split("[ \t-\r]+", text.lower().strip(" \t\n\v\f\r"))


def holds(docs, items, size):
    """Which documents hold a window of an item whose placeholders agree, by looking at every window of every text."""
    windows, found = collections.defaultdict(list), set()
    for item, text in items:
        t, r = template_of(text or ""), re.split("[ \t-\r]+", (text or "").strip(" \t\n\v\f\r"))
        n = size if len(t) > size else max(1, len(t) - 1)
        for k in range(len(t) - n + 1) if t[0] else ():
            slots = sum("⟨" in w for w in t[k : k + n])
            if slots < n and (2 * slots <= n or n == size):
                windows[tuple(t[k : k + n])].append((item, r[k : k + n], 2 * slots > n))
    for doc, text in docs:
        t, r = template_of(text or ""), re.split("[ \t-\r]+", (text or "").strip(" \t\n\v\f\r"))
        for n in {len(w) for w in windows}:
            for k in range(len(t) - n + 1):
                for item, raw, exact in windows.get(tuple(t[k : k + n]), ()):
                    pairs = {(w, a, b) for w, a, b in zip(t[k : k + n], raw, r[k : k + n]) if "⟨" in w}
                    one = len(pairs) == len({p[:2] for p in pairs}) == len({p[::2] for p in pairs})
                    if one and not (exact and any(a != b for _, a, b in pairs)):
                        found.add((doc, item))
    return found


def question(rng, vocabulary, values):
    """A question of 20 to 40 words about numbers, units and a name that stand somewhere in it."""
    body = [rng.choice(vocabulary) for _ in range(rng.randint(20, 40))]
    for k, v in zip(sorted(rng.sample(range(1, len(body)), len(values)), reverse=True), values):
        body.insert(k, v)
    return " ".join(["What", *body])


def test_reparameterised_questions_are_found(spark):
    """Numbers, units and names changed as a whole: presence equals brute force, and most are found; other texts aren't."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    names, items, docs = ["Anna", "Boris", "Clara", "Dmitri", "Elena"], [], []
    for i in range(120):
        rng.seed(100 + i)
        items.append((i, question(rng, vocabulary, [str(2 * i), f"{i + 500} km", rng.choice(names), rng.choice(names), f"{i}.5 hours"])))
        rng.seed(100 + i)
        changed = {n: f"{n}ya" for n in names}
        text = question(rng, vocabulary, [str(2 * i + 3000), f"{i + 7000} miles", changed[rng.choice(names)], changed[rng.choice(names)], f"{i + 9000}.5 minutes"])
        around = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(2)]
        docs += [(i, f"{around[0]}. {text} {around[1]}"), (1000 + i, f"{around[0]} {2 * i} km {around[1]}")]
    items += [(900, "1 2 3 4 5 6 7 8 9 10 sum 12 13 14 15 16"), (901, "x 7 kg"), (902, None)]
    docs += [(3000, "so 1 2 3 4 5 6 7 8 9 10 sum 12 13 14 end"), (3001, "so 1 2 3 4 5 6 7 8 9 10 sum 12 19 18 end"), (3002, "x 9 kg " * 5), (3003, None)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_decontamination.matches(spark, *tables, size=13).collect()}
    assert got == holds(docs, items, 13)
    assert sum((i, i) in got for i in range(120)) >= 108 and not any(1000 <= d < 2000 for d, _ in got)
    assert (3000, 900) in got and all((d, 900) not in got or d in (3000, 3001) for d, _ in got)


def test_decontamination_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in template_decontamination.matches(spark, docs, bench, size=13).collect()}
    assert got == holds([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()], 13)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head {0}</h1><p>One&nbsp;&amp; <b>t</b>wo<br>three {0}<p>four<div class="share-box">Share</div><!-- <p>no</p> --><form><p>mail</p></form></article>
<aside class=sidebar>Side</aside><section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(4)] + [(9, None, None), (10, "x", ""), (11, "http://one.example/", "<body><div id=menu>m</div><div class=text><p>alone</p><p>page</p></div>")]
    got = {r["page_id"]: r for r in template_extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == "Head 2 One & two three 2 four" and got[2]["n_chars"] == len(got[2]["text"])
    assert (got[9]["text"], got[10]["text"], got[11]["text"]) == ("", "", "alone page")


def test_markup_is_read_in_linear_time():
    import time

    began = time.process_time()
    for source in ("<a " * 350_000, "<a '" * 250_000 + ">", "<p>x" * 100_000, "<!--" * 250_000, '<a "' * 100_000 + "<p>end</p>", "<center>" * 50_000 + "deep" + "</x>" * 50_000, "</p>" * 200_000):
        template_extraction.parse(source)
    assert time.process_time() - began < 30
    assert [x[1] for x in template_extraction.parse('<p>one <b>two</b> a < b<p title="x>y">three').slots] == ["one two a < b", "three"]
    assert [x[1] for x in template_extraction.parse('<p>a</p><a href="x>tail <p>b</p>').slots] == ["a", "tail", "b"]


UNNAMED = """<html><body><div class="a1"><ul><li>Home</li><li>News</li></ul></div><div class="b2">Read our terms before use</div>
<div class="c3"><h2>Piece {0}</h2><p>Story {0} about {1} things.</p><p>More {1}.</p></div><div class="d4">Copyright Example</div></body></html>"""


def test_unnamed_pages_give_only_the_article(spark, monkeypatch):
    rows = [(i, f"http://u.example/{i}", UNNAMED.format(f"n{i}", f"m{i * i}")) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in template_extraction.extract(spark, frame).collect()}
    assert got == {i: f"Piece n{i} Story n{i} about m{i * i} things. More m{i * i}." for i in range(6)}
    twice = template_extraction.extract(spark, frame.unionByName(frame)).collect()
    assert collections.Counter(r["text"] for r in twice) == collections.Counter({t: 2 for t in got.values()})
    assert template_extraction.extract(spark, frame.where("false")).count() == 0


NEUTRAL = """<body><div class=c7>Free shipping on all orders</div><div class=c1><ul><li>Home<li>About us</ul></div>
<div class=c2><h2>Title {0}</h2><p>Body text {0} of {0}</p><div class=c8>Read this too</div><p>and all the same end</p></div><div class=c9>Made by us</div></body>"""


def test_constant_text_is_template_whatever_its_names(spark):
    rows = [(i, f"http://n.example/{i}", NEUTRAL.format(f"w{i % 5}")) for i in range(8)]  # three pages are copies
    got = {r["page_id"]: r["text"] for r in template_extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title w{i % 5} Body text w{i % 5} of w{i % 5} and all the same end" for i in range(8)}


def test_vectors_decide():
    roles = [{"path": p, "vector": v, "pages": 4, "chars": c, "own": o, "letters": o} for p, v, c, o in (("b", "1", 100, 0), ("b/d.c1", "1", 60, 60), ("b/d.c2", "1", 40, 40))]
    word = [{"path": "b/d.c1", "vector": v, "chars": 60} for v in ("1", "2")]
    assert template_extraction.deduce(roles, 4, word[:1])["constant"] == ["b/d.c1"] and template_extraction.deduce(roles, 4, word[:1])["article"] == "b/d.c2"
    assert template_extraction.deduce(roles, 4, word[1:])["constant"] == [] and template_extraction.deduce(roles, 4, word[1:])["article"] == "b"


def test_template_classes_nest():
    roles = [{"path": p, "vector": v, "pages": 4, "chars": c} for p, v, c in (("html", 1, 100), ("html/body", 1, 100), ("html/body/article", 1, 90), ("html/body/article/p", 2, 80), ("html/body/x", 3, 5))]
    got = template_extraction.deduce(roles, 4)
    assert got["article"] == "html/body/article"
    assert [t["paths"][0] for t in got["template"]] == ["html", "html/body/x", "html/body/article/p"] or got["template"][0]["parent"] is None
    assert all(t["parent"] == 0 for t in got["template"][1:])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0
    assert docs.where("piece = 0").count() == sizes[-1]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    tokens = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert tokens.where("n <> end or n > 1024").count() == 0


def test_ids_crc(spark):
    got = bestfit_packing.op5_best_fit_packing(spark, SF).limit(1).count()
    assert got == 1 and zlib.crc32(np.array([2], "<u4").tobytes()) == spark.createDataFrame([(bytearray(np.array([2], "<u4").tobytes()),)], "ids binary").select(F.crc32("ids")).head()[0]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert collections.Counter(tuple(r) for r in got.select(columns).collect()) == collections.Counter(want.select(*columns).fetchall())


def test_units_meet_their_verdicts(spark, monkeypatch):
    """Rows with hashes, without, and longer than a unit, in several chunks, buckets and batches."""
    monkeypatch.setattr(exchange, "BUCKET_HASHES", 64)
    assert [exchange.bucket_bits(n) for n in (0, 64, 65, 129, 1000)] == [0, 0, 1, 2, 4]
    own = np.sort(np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64))
    for bits in (0, 1, 5, 40):
        names, edges = exchange.bucketed(own, bits)
        assert names.tolist() == sorted({int(x) >> (64 - bits) if bits else 0 for x in own}) and edges[-1] == 300
    long = " ".join(f"long{i}" for i in range(400_000))  # over 4 MB: two of them make no unit
    texts = [None, "", "few words", *(f"{i % 700} " + " ".join(f"w{(i % 700) * 7 + j}" for j in range(40)) for i in range(1500)), long, "x", long + " end", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = {r["doc_id"]: r for r in substring_sketch.remove_repeats(spark, frame, window=20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(rows) == list(range(len(texts)))
    again = collections.Counter(tuple(w[k : k + 20]) for t in texts if len(w := words_of(t)) < 100 for k in range(len(w) - 19))
    for i, text in enumerate(texts):
        w = words_of(text)
        if len(w) < 100:
            gone = {k + j for k in range(len(w) - 19) if again[tuple(w[k : k + 20])] > 1 for j in range(20)}
            assert (rows[i]["n_words"], rows[i]["n_removed"]) == (len(w), len(gone))
    assert rows[1503]["n_removed"] == 400_000 and rows[1505]["text"] == "end"
