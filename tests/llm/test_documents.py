"""Each operator over the smallest tables and a table of awkward rows, against brute force or SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, differences

import corpus_pipeline
import public_tokenizers
from tabloom.llm import decontaminate, language_id, licenses, mixing, near_duplicates, quality_ledger, registered, run_index, token_counts, token_files
from tabloom.llm.common import scratch_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, _mix int"
LONG = "one two three four five six seven eight nine ten " * 3000


def awkward():
    near = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, None, "en", "a"), (2, "", "en", None), (None, near, None, "a"), (3, near, "de", "b"), (3, near, "de", "b"), (4, near + " tail", "de", "b"),
        (5, LONG, "en", "a"), (6, LONG + "All rights reserved. CC BY", "en", "c"), (7, "a" * 500, "fr", "a"), (8, "x\u0000é 'S <|endoftext|> İ K", "fr", "a"),
        (9, " \t\n\u000b ", "en", "b"), (10, "short one", "es", None), (11, "short one", "es", "c"), (None, None, None, None),
    ]
    return [(i, t, lang, src, len(t or ""), "clash", "clash", 0) for i, t, lang, src in texts]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """``name: (folder, rows)`` of the given documents, the awkward ones and none."""
    out = {}
    for name, rows in (("awkward", awkward()), ("empty", [])):
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
        for other in ("benchmark", "pages"):
            given = spark.read.parquet(f"{sf_dir}/{other}.parquet")
            given.limit(0 if name == "empty" else 5).write.parquet(f"{path}/{other}.parquet")
        out[name] = (str(path), [(r[0], r[1]) for r in rows])
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return out | {"given": (sf_dir, [(r.doc_id, r.text) for r in given])}


NAMES = ["given", "awkward", "empty"]


def found(spark, tables, name, query, *columns):
    folder, rows = tables[name]
    return Counter(tuple(r[c] for c in columns) for r in registered.QUERIES[query](spark, folder).collect()), rows


@pytest.mark.parametrize("name", NAMES)
def test_license_scan(spark, tables, name):
    got, rows = found(spark, tables, name, "op2_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter()
    for key, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want[key, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want


def test_license_templates_survive_an_inserted_word(spark):
    rows = [(1, "Licensed under the really Apache License, Version 2.0"), (2, "licensed under the GNU General Public License version 3"), (3, "under the bridge")]
    out = {r["key"]: {s["label"] for s in r["spans"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: {"apache-2.0"}, 2: {"gpl", "gpl-3.0"}, 3: set()}


@pytest.mark.parametrize("name", NAMES)
def test_mixing(spark, tables, name):
    folder, rows = tables[name]
    got = registered.QUERIES["op3_mixing"](spark, folder).collect()
    sources = Counter()
    by_row = spark.read.parquet(f"{folder}/documents.parquet").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in by_row:
        sources[r.source] += size(r.text)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode())))}
    target, left, free = {}, float(sum(sources.values())), set(sources)
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sources[s]}
        if not over:
            break
        target |= {s: 3.0 * sources[s] for s in over}
        left -= sum(3 * sources[s] for s in over)
        free -= over
    target |= {s: weight[s] * share for s in free}
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter((r.doc_id, size(r.text), sources[r.source], round(target[r.source], 6)) for r in by_row)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - sum(target.values())) <= len(sources)
    order = [r.position for r in got if r.position is not None]
    assert order == sorted(order)


@pytest.mark.parametrize("shape", mixing.SHAPES)
def test_demand_is_inverted(spark, shape):
    out = spark.range(101).selectExpr("id / 100D AS u").select("u", mixing.demand(shape, mixing.time_of(shape, __import__("pyspark").sql.functions.col("u"))).alias("v")).collect()
    assert all(abs(r.u - r.v) < 1e-9 for r in out)


@pytest.mark.parametrize("name", NAMES)
def test_language_id(spark, tables, name):
    got, rows = found(spark, tables, name, "op4_language_id", "doc_id", "held_out")
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0
    assert got == Counter((k, held(k)) for k, _ in rows)


def test_language_accuracy(spark, sf_dir):
    rows = language_id.op4_language_id(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_rules(spark, sf_dir, tables):
    assert differences(quality_ledger.op5_quality_rules(spark, sf_dir), connect(sf_dir), quality_ledger.OP5_SQL) == []
    book = quality_ledger.ledger(spark.read.parquet(tables["awkward"][0] + "/documents.parquet"))
    assert book.count() == len(awkward()) and "size" in book.columns
    costs = {(r.policy, r["rule"]): r.only_this_rule for r in quality_ledger.ablation(book).collect()}
    for policy, rules in quality_ledger.POLICIES.items():
        for rule in rules:
            rest = quality_ledger.mask(tuple(x for x in rules if x != rule))
            assert costs[policy, rule] == book.filter(~quality_ledger.passes(policy)).filter(f"(failed_bits & {rest}) = 0").count()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", NAMES)
def test_tokens(spark, tables, tokenizer, name):
    got, rows = found(spark, tables, name, "op6_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")
    ids = [e.ids for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((k, len((t or "").encode()), len(x), len(x) > 2048) for (k, t), x in zip(rows, ids))
    got, rows = found(spark, tables, name, "op7_token_files", "doc_id", "n_tokens", "ids_crc32")
    assert got == Counter((k, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (k, _), x in zip(rows, ids))


def test_token_files_are_a_stream_in_order(spark, sf_dir, tokenizer):
    folder = scratch_folder(spark, "test-tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_files.write_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), length=64).orderBy("part").collect()
    whole = []
    for r in manifest:
        file = token_files.TokenFile(__import__("pyarrow").fs.LocalFileSystem(), f"{folder}/{r.name}")
        for i in range(-(-r.n_ids // 64)):
            ids, mask = file.sequence(i)
            assert len(ids) == 64
            whole += ids[mask].tolist()
    want = [i for r in docs.orderBy("doc_id").collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]]
    assert whole == want


@pytest.mark.parametrize("name", NAMES)
def test_repeated_spans(spark, tables, name):
    got, rows = found(spark, tables, name, "op8_repeated_spans", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    last, first, want = 1 << 62, {}, Counter()
    rows = [(k, (t or "").encode()) for k, t in rows]
    for key, data in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], last if key is None else key)
    for key, data in rows:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < (last if key is None else key):
                gone[p : p + 50] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want[key, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(left).hexdigest()] += 1
    assert got == want


def test_decontamination(spark, tables, sf_dir):
    got, rows = found(spark, tables, "given", "op9_decontamination", "doc_id", "item_id")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(got) == {(k, i) for k, t in rows for i, x in items if t and x in t}
    for name in ("awkward", "empty"):
        assert found(spark, tables, name, "op9_decontamination", "doc_id")[0] == Counter()
    asked = "How far does a train go when Alice drives it for 5 hours at 80 km and Alice then stops it for 5 minutes"
    again = [
        (1, "Once more. " + asked.replace("Alice", "Boris").replace("80", "95")),
        (2, asked.replace("Alice", "Boris", 1).replace("when Boris", "when Clara")),
        (3, "A train goes far."), (4, None),
    ]
    bench = spark.createDataFrame([(7, asked), (8, None), (9, "")], "item_id long, text string")
    out = decontaminate.contaminated(spark.createDataFrame(again, "doc_id long, text string"), bench).collect()
    # in the second text one name of the item has become two
    assert [(r.doc_id, r.item_id, r.same_values) for r in out] == [(1, 7, False)]


def components(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, own in enumerate(sets):
        met = Counter(j for x in own for j in where[x])
        for x in own:
            where[x].append(i)
        for j, both in met.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[top(i)].append(key)
    return [(rows[i][0], len(sets[i]), min((k for k in least[top(i)] if k is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("name", NAMES)
def test_near_duplicates(spark, tables, name):
    got, rows = found(spark, tables, name, "op10_near_duplicates", "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter((k, n, c, k == c) for k, n, c in components(rows, 4, 80))


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns
        kept[name] = (docs, after)
        docs = after
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = kept["quality rules"]
    assert after.count() == quality_ledger.ledger(before).filter("failed_bits = 0").count()
    before, after = kept["near-duplicates"]
    assert sorted(k for k, _ in rows(after)) == sorted({c for _, _, c in components(rows(before), 5, 80)})
    before, after = kept["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert sorted(k for k, _ in rows(after)) == sorted(k for k, _ in rows(before) if k not in bad)
    before, after = kept["mixture"]
    # documents are whole, and a source misses its target by half of a document at most
    assert set(rows(after)) <= set(rows(before))
    sizes = [len(t.split()) for _, t in rows(before)]
    sources = before.select("source").distinct().count()
    assert abs(sum(len(t.split()) for _, t in rows(after)) - sum(sizes)) <= sources * (max(sizes) / 2 + 1)
    order = [r.doc_id for r in kept["token files"][1].orderBy("start").collect()]
    assert order == [r.doc_id for r in after.selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]


@pytest.mark.parametrize("limits", [{"DEPTH": 1}, {"WIDE": 50}, {"DEPTH": 2, "SMALL": 150, "WIDE": 40, "CELLS": 32}], ids=["last depth", "blocks", "branches"])
def test_pairs_inside_a_large_family(spark, monkeypatch, limits):
    # 400 texts 0.71 alike, and a copy of some that is 0.8 to 0.82 like its own only
    for name, value in limits.items():
        monkeypatch.setattr(near_duplicates, name, value)
    family = [[f"c{i}" for i in range(100)] + [f"w{i}x{j}" for j in range(20)] for i in range(400)]
    family += [family[i][: -12 - i % 2] + [f"z{i}x{j}" for j in range(12 + i % 2)] for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(family)], "doc_id long, text string")
    got = {r.key: r.component_id for r in near_duplicates.linked_components(docs).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in range(440)}


def test_pipeline_on_awkward_and_empty_tables(spark, tables):
    names = ["n_words", "failed_bits", "row", "doc", "mix", "pass", "h", "_pass", "_bad", "_order", "_h"]
    for name in ("awkward", "empty"):
        folder, _ = tables[name]
        docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"concat('mine ', doc_id) AS {x}" for x in names])
        for title, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns, title
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in docs.collect()}, title
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_overlaps_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(near_duplicates, "CELLS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(23)]
    got = np.concatenate(list(near_duplicates._overlaps(sets)))
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_one_of_each_keeps_columns_of_any_name(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "a"), (1, words, "a"), (2, words + " more", "b"), (3, "other text", "c"), (None, None, "d"), (None, None, "d"), (4, " \t", "e"), (None, words, "f")]
    docs = spark.createDataFrame([(*r, r[2], r[2], r[2], r[2]) for r in rows], "doc_id long, text string, order string, h string, _order string, row string, first string")
    out = near_duplicates.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.h for r in out.collect()) == ["a", "c", "d", "d", "e"]
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_pairs_at_the_threshold_stay_together_at_the_last_depth():
    trees, two = near_duplicates.trees_for(0.8), near_duplicates.second_branch(0.8)
    assert trees >= 10 and near_duplicates.recall(0.8, trees, near_duplicates.DEPTH) >= near_duplicates.RECALL
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(300):  # 104 of 130 shingles shared, every node large
        hashes = rng.integers(0, 1 << 64, 130, np.uint64)
        (starts, paths, _), (others, ways, _) = near_duplicates.sketch(hashes[:117], trees), near_duplicates.sketch(hashes[13:], trees)
        nodes = int((starts == others).sum())
        for _ in range(near_duplicates.DEPTH):
            nodes = sum(paths[i] == ways[i] for _ in range(nodes) for i in set(rng.integers(0, near_duplicates.PATHS, 1 + (rng.random() < two)).tolist()))
        met += nodes > 0
    assert met >= 297


def test_verbatim_items_are_found(spark):
    long = "A farmer who lives near the old river sells 12 baskets of apples on every market day and keeps the money in a box under the floor until his daughter counts the 12 coins that remain after paying for the repair of the roof and for a new wooden door"
    items = [(1, "Compute 12 * 34 + 56"), (2, "What is the capital of France"), (3, long), (4, "The Old Man And The Sea By Ernest Hemingway In Paris")]
    docs = [
        (1, "Please compute. Compute 12 * 34 + 56 now"), (2, "Question: What is the capital of France? Paris."), (3, "Read this. " + long.replace("12", "13", 1)),
        (4, "We like The Old Man And The Sea By Ernest Hemingway In Paris most"), (5, "Compute the sum of 12 and 34"), (6, "Question: What is the capital of Spain?"),
        (7, "Then Where is the capital of France"),
    ]
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.same_values) for r in out) == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, True), (6, 2, False)]


def test_words_are_learnt_for_many_texts_at_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tabloom.llm.wordpieces import WordPieces

    path, calls = public_tokenizers.path("word_bpe_49k.json"), []
    pieces, library, learn = WordPieces(path), Tokenizer.from_file(path), WordPieces._learn
    monkeypatch.setattr(WordPieces, "_learn", lambda self, words: (calls.append(1), learn(self, words)))
    letters = ["aB", "É", "ÀÿÐ", "ß", "×", "µ", "ς", "é", "İ", "9", "'s"]
    marks = ["", ".", "),", "***", "<|", "'", "-x", "$\x7f", "\x1c"]
    texts = [f"{a}{b}{c} {b}{a}{c}{i}" for i, a in enumerate(letters) for b in letters for c in marks] + [""]
    got = [x.tolist() for x in pieces.ids(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1


def test_a_word_is_learnt_once_whatever_its_case_and_marks():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tabloom.llm.wordpieces import WordPieces

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, library = WordPieces(path), Tokenizer.from_file(path)
    few = ["Word word, WORD.", "", "word: été, word.\nété"]
    # what must not be cut or lower-cased: added tokens, letters that marks join, words of other bytes
    odd = ["a<|endoftext|>, B<|ENDOFTEXT|>.", "H\u0331. h\u0331 E\u0301, \u212a\u0340.", "Don'T, x.y,\u2026Z. 3.14, \u2029. \x1cA,", ".", " \n", "ÉTÉ, É-a"]
    got = [[x.tolist() for x in pieces.ids(t.encode() for t in few)], len(pieces.number), [x.tolist() for x in pieces.ids(t.encode() for t in odd)]]
    encoded = [[library.encode(t, add_special_tokens=False).ids for t in texts] for texts in (few, odd)]
    # word, été, the comma, the full stop, the colon
    assert got == [encoded[0], 5, encoded[1]]
    lengths = [int(pieces.length[x].sum()) for x in pieces.numbers(t.encode() for t in few + odd)]
    assert lengths == [len(x) for x in encoded[0] + encoded[1]]


def test_a_worker_keeps_the_words_of_one_operator():
    import public_tokenizers

    from tabloom.llm import common, decontaminate, near_duplicates
    from tabloom.llm.wordpieces import word_pieces

    pieces = word_pieces(public_tokenizers.path("word_bpe_49k.json"))
    assert word_pieces(public_tokenizers.path("word_bpe_49k.json")) is pieces
    one = near_duplicates.shingles(b"a b c d e f", 4)
    assert list(common._kept) == ["shingle words"]
    decontaminate.template("Ann has 3 apples")
    assert list(common._kept) == ["vocabulary"]
    assert (near_duplicates.shingles(b"a b c d e f", 4) == one).all() and len(common._kept) == 1
