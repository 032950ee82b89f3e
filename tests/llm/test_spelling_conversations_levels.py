import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise, product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, duck

from clickwright.llm import conversations, level_packing, spelling, word_tokens
from clickwright.llm.queries import ORACLE, QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair"])
def test_equal_to_sql(spark, small_dir, name):
    for sf in (small_dir, "/root/testdata/sf0.01"):
        res = compare(QUERIES[name](spark, sf), ORACLE[name], duck(sf))
        assert res["ok"], res


# ---------------------------------------------------------------- spelling


def near_by_force(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_force(n: dict[str, int], ratio: int = 5) -> dict:
    near = {w: [v for v in n if near_by_force(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def words_of(docs, at_least, times):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= at_least and c >= times}


def got_forms(words, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(words, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"direct": 1}, {"first": 2, "second": 4}, {"first": 3, "second": 2, "direct": 2}])
def test_forms_of_random_words(spark, how):
    rng = np.random.default_rng(len(how))
    words = {"".join(rng.choice(list("abcÉé"), rng.integers(6, 9))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "colour", "color", "colours", "coluor"}
    n = {w: int(5 ** rng.integers(1, 8)) for w in words}
    table = spark.createDataFrame([(w, c, "".join(sorted(w))) for w, c in n.items()], "word string, n long, letters string")
    assert got_forms(table, **how) == forms_by_force(n)


def test_vectors_are_near_or_not(spark):
    """Every pair of vectors at the distances in question, and none twice."""
    rng = np.random.default_rng(3)
    vectors = {"".join(sorted(rng.choice(list("abcdefgh"), rng.integers(6, 9)))) for _ in range(150)}
    table = spark.createDataFrame([(v,) for v in vectors], "letters string")
    want = set()
    for a, b in product(vectors, repeat=2):
        lost, gained = Counter(a) - Counter(b), Counter(b) - Counter(a)
        if a != b and lost.total() <= 1 and gained.total() <= 1:
            want.add((a, b, "".join(lost), "".join(gained)))
    for direct in (256, 2):
        got = [tuple(r) for r in spelling.near_vectors(table, direct=direct).select("a", "b", "lost", "gained").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_words_of_odd_rows(spark, odd, repeated, empty):
    for docs in (odd, repeated, empty):
        found = spelling.runs(docs, at_least=3)
        words = spelling.word_counts(found.select(spelling.misspelt(found).alias("word")), at_least=3, times=2)
        n = words_of([(r.doc_id, r.text) for r in docs.collect()], 3, 2)
        assert {r.word: r.n for r in words.collect()} == n
        assert got_forms(words) == forms_by_force(n)


# ---------------------------------------------------------------- conversations


def accepted(roles: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def repair_by_force(rows: list[tuple[str, str]]) -> tuple:
    """(blank, duplicate, truncated, illegal, cost, audit, text): all states of a plain automaton with whole audits."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("p", "u"): "u", ("u", "a"): "p"}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(live):
        todo = list(live.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            for c, name in names.items():
                to = moves.get((state, c))
                new = (cost + 2, audit + "I", (*lines, f"{name}:"))
                if to and (to not in live or new < live[to]):
                    live[to] = new
                    todo.append((to, new))
        return live

    live = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        before, live = with_inserts(live), {}
        for state, (cost, audit, lines) in before.items():
            ways = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                ways += [(moves.get((state, role[:1])), (more, audit + "K", (*lines, f"{role}:{text}")))]
                ways += [(moves.get((state, c)), (more + 2, audit + "R", (*lines, f"{n}:{text}"))) for c, n in names.items()]
            for to, new in ways:
                if to is not None and (to not in live or new < live[to]):
                    live[to] = new
    cost, audit, lines = min(v for k, v in with_inserts(live).items() if k in ("", "p"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


ROLE = st.sampled_from(["user", "assistant", "system", "tool", " "])
TEXT = st.sampled_from(["Yes.", "No", "", " \n", "Why? ", "a\nb!"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=12), st.integers(1, 5))
def test_repair_of_parts(rows, size):
    """A conversation repaired whole, and from the tables of its parts, equals the plain automaton."""
    want = repair_by_force(rows)
    seen, held = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        held.append((role, text, role[:1], 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    found = conversations.whole(held)
    digest = hashlib.sha256(want[-1].encode()).hexdigest()
    assert (found["whole_cost"], found["audit"], found["sha"]) == (want[4], want[5], digest)
    parts = [held[i : i + size] for i in range(0, len(held), size)]
    runs = [conversations.counts(p, [None] * len(p)) | conversations.tops(p) for p in parts]
    if runs:
        total = runs[0]
        for r in runs[1:]:
            total = conversations.joined(total, r)
        assert tuple(total[c] for c in ("blank", "duplicate", "truncated", "illegal")) == want[:4]
        assert conversations.ending(conversations.across({0: (0, 0)}, total))[0] == want[4]


def test_grammar_is_the_language():
    g = conversations.RoleGrammar()
    for n in range(7):
        for roles in product("sua", repeat=n):
            live = {0}
            for c in roles:
                live = {to for at in live for to in g.shifts.get((at, c), [])}
            assert any(x in g.accepting for x in live) == accepted("".join(roles))
    with pytest.raises(ValueError):
        conversations.RoleGrammar((("S", "uS"), ("S", "a")))


def by_conversation(rows):
    """What repair_all should say, from rows (conv_id, turn, role, text) as they are after damage."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, held in groups.items():
        held.sort()
        turns = {t for told, t, _, _ in held if told}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *counts, cost, audit, text = repair_by_force([(r, t) for _, _, r, t in held])
        out[c] = (gaps, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got_repairs(rows, originals, **how):
    return {r[0]: tuple(r)[1:] for r in conversations.repair_all(rows, originals, **how).collect()}


@pytest.mark.parametrize("block_rows", [2, 3, 4096])
def test_conversations_across_tasks(spark, block_rows):
    """One conversation holds most rows, so its blocks lie in several tasks; null ids, turns, roles and texts; repeated rows."""
    rng = np.random.default_rng(block_rows)
    texts, roles = ["Yes.", "No", "", None, "Why? ", *[f"Line {i}." for i in range(60)]], ["user", "assistant", "system", None, "user", "assistant"]
    rows = [(7 if i % 3 else int(rng.integers(20)), int(rng.integers(300)) if i % 11 else None, roles[rng.integers(6)], texts[rng.integers(len(texts))]) for i in range(700)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (99, 0, "user", "Same."), (99, 0, "user", "Same.")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, block int")
    clean = conversations.conversation_rows(table)
    assert got_repairs(clean, clean, block_rows=block_rows) == by_conversation(rows)


def test_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = conversations.conversation_rows(spark.createDataFrame([], schema))
    assert got_repairs(empty, empty) == {}
    some = conversations.conversation_rows(spark.createDataFrame([(1, 0, "user", "Hi."), (None, None, None, None)], schema))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got_repairs(some.limit(0), some) == {1: nothing, None: nothing}
    long = conversations.conversation_rows(spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], "long " * 300_000 + f"{i}.") for i in range(4)], schema))
    assert got_repairs(long, long)[1][:7] == (0, 0, 0, 0, 0, 0, "KKKK")


# ---------------------------------------------------------------- sum of squares


def test_level_choice_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(5)
    size, levels, count = 64, level_packing.Levels(64), Counter()
    for n in rng.integers(1, size, 3000).tolist():
        squares = {}
        for h in [0, *[h for h in count if count[h] and h + n <= size]]:
            after = Counter(count)
            after[h] -= h > 0
            after[h + n] += h + n < size
            squares[h] = sum(v * v for v in after.values())
        best = max(h for h, s in squares.items() if s == min(squares.values()))
        assert levels.choose(n) == best
        levels.place(("d", 0, None, n), n)
        count[best] -= best > 0
        count[best + n] += best + n < size
        assert {h: c for h, c in count.items() if c} == {int(h): int(levels.count[h]) for h in np.flatnonzero(levels.count)}


def test_word_encoder_equals_library(small_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    assert word_tokens.word_encoder(WORDS).by_word
    want = [e.ids for e in tok.encode_batch_fast(small_texts, add_special_tokens=False)]
    assert [x.tolist() for x in word_tokens.text_ids(WORDS, small_texts)] == want
    assert [x.tolist() for x in word_tokens.text_ids(WORDS, small_texts)] == want  # from the memo


@pytest.fixture(scope="module")
def small_texts(spark, small_dir):
    odd = ["", " ", "a\u0085b c d", "e ́x", "İΑΣ ΑΣΑ's <|endoftext|>it's", "\x1c\x00a\tb\r\nc", "x" * 5000, "한국어 텍스트 ﻿日本"]
    return odd + [r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]


def check_packing(docs, size, **how):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    placed = [r.asDict() for r in level_packing.place_documents(docs, WORDS, size, end_id=1, **how).collect()]
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in placed:
        pieces[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append(p)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    assert pieces.keys() == texts.keys()
    for doc, all_ids in texts.items():
        if len(all_ids) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(all_ids[0])
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(all_ids[0][p["start"] : at])
            assert at == len(all_ids[0])
        else:
            assert sum(p["length"] for p in pieces[doc]) == sum(map(len, all_ids))
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size and (at == size or not at & (at - 1))  # nothing to pad
    return placed, windows


def test_level_packing(spark, small_dir, odd, repeated, empty):
    small = spark.read.parquet(f"{small_dir}/documents.parquet")
    placed, windows = check_packing(small, 2048)
    total = sum(p["length"] for p in placed)
    assert len(windows) <= -(-total // 2048) + 11
    check_packing(small, 256, shard_items=32)
    check_packing(odd, 64)
    check_packing(repeated, 64, shard_items=4)
    assert level_packing.place_documents(empty, WORDS).count() == 0
    nulls = spark.createDataFrame([(i, None) for i in range(40)], "doc_id long, text string")
    check_packing(nulls, 16)
