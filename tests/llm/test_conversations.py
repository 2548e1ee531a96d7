"""Chat formatting and the prefix trie against brute force, with awkward conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tabloom.llm import chat_format, prefix_trie
from tabloom.llm.chat_format import PART, escape, unescape

LONG = "long text </s> " * 20000
SCHEMA = "conv_id long, turn long, role string, text string, parts string, key int, shard int"


def awkward():
    rows = [
        (1, 0, "user", "<s>[INST]<~s><~~/s>[~/INST]"), (1, 1, "assistant", "<image></s>[INST] é\u0000\U0001f600"), (1, 2, None, None), (2, None, "system", LONG),
        (2, 5, "assistant", LONG), (2, 3, "assistant", ""), (3, 0, "ro\nle[INST]", "x"), (4, 0, "assistant", "<"), (4, 1, "assistant", "/s>"), (100, 0, "user", "a"),
        (100, 1, "assistant", "b"), (101, 0, "user", "a"), (101, 1, "assistant", "b"), (199, 0, "user", "z"), (102, 0, "x", "q"), (-12, 0, "user", "n"), (250, 0, "user", "only"), (1234, 7, "user", "a"),
    ]
    return [(*r, "clash", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    out = {}
    for name, rows in (("awkward", awkward()), ("empty", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out[name]}/conversations.parquet")
    return out | {"given": sf_dir}


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def ordered(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}


sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["given", "awkward", "empty"])
def test_chat_format(spark, tables, name):
    rows = rows_of(spark, tables[name]) + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, turns in ordered(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        marks = sum(len("<s>[INST][/INST]</s>") + len(escape(r)) + len(escape(x)) for r, x in turns)
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), marks)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.op12_chat_format(spark, tables[name]).collect()}
    assert got == want


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    bits = ["<", "[", "~", "s>", "/s>", "INST]", "/INST]", "image>", "audio>", "document>", "</s>", "x", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        hidden = escape(text)
        assert unescape(hidden) == text
        assert not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>"))


def test_parts_are_flattened_in_order_and_come_back(spark, tmp_path):
    text = lambda t: ("text", t, None, None, None, None, None)
    image, audio = ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.1, None)
    pdf, odd = ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d.mp4", None, None, None, None)
    rows = [
        (1, 0, "user", [text("see <image> "), image, text("and"), audio, text(""), pdf, text("?")]), (1, 1, "assistant", [text("yes "), image, text("</s>"), text("!")]),
        (1, 2, "assistant", None), (None, None, None, [None, odd, text(None), (None, "free", None, None, None, None, None)]), (2, 0, "user", []),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{PART}>")
    chat_format.write_conversations(chat_format.format_turns(turns), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    by_turn = {(r["key"], r.turn): r for r in out.collect()}
    first, second = by_turn[1, 0], by_turn[1, 1]
    assert first.formatted == "<s>user[INST]see <~image> <image>and<audio><document>?[/INST]</s>"
    assert [(a.kind, a.ref, a.tokens, first.formatted[a.start :][:3]) for a in first.attachments] == [
        ("image", "a.png", 3, "<im"), ("audio", "b.wav", 53, "<au"), ("document", "c.pdf", 1536, "<do")
    ]
    assert first.attachment_tokens == 1592 and first.loss == []
    assert "".join(unescape(second.formatted[s.start : s.start + s.length]) for s in second.loss) == "yes </s>!"
    assert by_turn[None, None].attachments[0].tokens == chat_format.Costs().unknown
    back = {(r["key"], r.turn): (r.role, [tuple(p) for p in r.parts]) for r in chat_format.restored(out).collect()}
    assert back == {
        (1, 0): ("user", [text("see <image> "), image, text("and"), audio, pdf, text("?")]), (1, 1): ("assistant", [text("yes "), image, text("</s>!")]),
        (1, 2): ("assistant", []), (None, None): ("", [("document", None, "d.mp4", None, None, None, None), text("free")]), (2, 0): ("user", []),
    }


def brute_trie(rows):
    own = ordered(r for r in rows if r[0] is not None)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        if path:
            saved[path] += (len(members[path]) - 1) * len(path[-1][1])
            children[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    ends = lambda path, ids: sha(",".join(str(c) for c in sorted(ids) if whole[c] == path))
    return Counter(
        (min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path], leaves[path], saved[path], ends(path, ids)) for path, ids in members.items()
    )


@pytest.mark.parametrize("name", ["given", "awkward", "empty"])
def test_trie(spark, tables, name):
    got = Counter(tuple(r) for r in prefix_trie.op13_prefix_trie(spark, tables[name]).collect())
    assert got == brute_trie(rows_of(spark, tables[name]))


@pytest.mark.parametrize("width, letters", [(5, "ab"), (6, "a")])
def test_trie_of_many_shards_and_blocks(spark, monkeypatch, width, letters):
    """Matrices of 64 rows and a few depths, so that nodes reach over shards and sequences over blocks."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "CELLS", 8)
    rng = random.Random(width)
    rows = [(c, t, "user", rng.choice(letters)) for c in [*range(300), -5, 777] for t in range(rng.choice([1, 2, 3, 5, 9, 14, 24]))]
    rows += [(400 + c, t, "user", "same") for c in range(40) for t in range(9)]  # a large group of copies
    rows.append((None, 0, "user", "no conversation"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed(turns))).collect())
    assert got == brute_trie(rows)


def test_places_go_on_over_ranges(spark):
    rows = [(c, t, "user", "x" * (t % 7)) for c in (5, 6) for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = {(r["key"], r.place): r.upto for r in prefix_trie.placed(turns).collect()}
    want, total = {}, Counter()
    for c, t, _, x in rows:
        total[c] += len(x)
        want[c, t] = total[c]
    assert found == want
