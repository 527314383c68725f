from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import lower, odd_texts, table

from reelgrid.llm.conversation_trie import list_ranks, ordered_turns, prefix_trie
from reelgrid.llm.exact_dup import Patricia, common, exact_duplicates
from reelgrid.llm.phrases import collocations, frequent_phrases, pack
from reelgrid.llm.store import Workspace

# -- exact duplicates ------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[lower(text)].append((doc_id, i))
    out = []
    for text, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        keep = max(ids, default=None)
        first = next(i for d, i in members if d == keep)
        out += [(d, keep, len(members), i == first, hashlib.sha256(text.encode()).hexdigest()) for d, i in members]
    return Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"hash_bits": 0, "trie_bytes": 3_000}, {"hash_bits": 1, "trie_bytes": 1, "tasks_per_salt": 1}])
def test_exact_duplicates(spark, sizes):
    """Odd rows and many copies; with a useless hash and no memory the tries alone
    tell texts apart, over many rounds of spilled subtrees."""
    r = random.Random(5)
    base = ["shared beginning " * 3 + "".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(30)]
    rows = odd_texts() + [(200 + i, (r.choice(base) if i % 3 else "One same text").replace("a", r.choice("aA"))) for i in range(200)]
    got = exact_duplicates(table(spark, rows).repartition(5), **sizes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # Rows that repeat are alike, so which of them comes first doesn't show.
    assert Counter(map(tuple, got.collect())) == exact_by_hand(rows)


def test_exact_duplicates_smallest_and_empty(spark):
    got = exact_duplicates(table(spark, [(3, "a"), (1, "A"), (None, "a"), (2, None), (None, "")]), keep="smallest").collect()
    assert sorted(((g.doc_id or 0), g.keep_id, g.group_size, g.kept) for g in got) == [(0, 1, 3, False), (0, 2, 2, False), (1, 1, 3, True), (2, 2, 2, True), (3, 1, 3, False)]
    assert exact_duplicates(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_patricia():
    r, trie, seen = random.Random(1), Patricia(), set()
    for _ in range(2_000):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        node = trie.find(text)
        assert (node.end is not None) == (text in seen)
        node.end, _ = text, seen.add(text)
    assert {t for t, e in trie.texts() if e == t} == seen == {t for t, _ in trie.texts()}
    for n in range(40):
        label = bytes(40)
        assert common(label, b"xx" + bytes(n) + b"\1" * 40, 2) == n


# -- phrases ---------------------------------------------------------------


def grams_by_hand(rows, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def collocations_by_hand(rows, shortest, longest, least, cover, top):
    f, n = grams_by_hand(rows, longest)
    many = {(lang, p): c for (lang, k, p), c in f.items() if k >= shortest and c >= least}
    count = {(lang, p): c for (lang, _, p), c in f.items()}
    found = defaultdict(list)
    for (lang, p), a in many.items():
        w = p.split(" ")
        best = min((1_000_000 * a * a // (count[lang, " ".join(w[:k])] * count[lang, " ".join(w[k:])]), k) for k in range(1, len(w)))
        inside = [c for (g, q), c in many.items() if g == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
        if not any(100 * c >= cover * a for c in inside):
            found[lang].append((best[0], a, p, count[lang, " ".join(w[: best[1]])], count[lang, " ".join(w[best[1] :])]))
    out = []
    for lang, x in found.items():
        x.sort(key=lambda t: (-t[0], -t[1], t[2].encode()))
        out += [(lang, i, p, a, le, r, n[lang], s) for i, (s, a, p, le, r) in enumerate(x[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(9)
    vocabulary = ["new", "York", "CITY", "of", "the", "day", "é", "漢", "zz"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", " \n "]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "de", None, "und"])) for _ in range(120)] + [("aa aa aa aa", "rep")] * 20
    return rows + [(None, "en"), ("", "en"), (" \t,.", None), ("...", "void"), (odd_texts()[8][1], "en"), ("one", "en"), ("x" * 70_000, "en")]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "bucket_ngrams": 300}])
def test_collocations(spark, sizes):
    rows = phrase_rows()
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(rows)]).drop("lang").join(spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "doc_id long, lang string"), "doc_id")
    assert sorted(map(tuple, collocations(docs, least=10, top=25, **sizes).collect())) == collocations_by_hand(rows, 2, 3, 10, 50, 25)
    rows = rows[:120]
    assert sorted(map(tuple, collocations(docs.where("doc_id < 120"), shortest=2, longest=4, least=6, cover_percent=80, top=None, **sizes).collect())) == collocations_by_hand(rows, 2, 4, 6, 80, 10**9)


def test_fingerprints_that_collide(spark, monkeypatch):
    """With few fingerprints most n-grams share one: the counts by text stay right."""
    import reelgrid.llm.phrases as phrases

    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string")
    # 33 bits are sent; all but the last 10 are cleared below by a hash of few values.
    whole = phrases.mix
    monkeypatch.setattr(phrases, "mix", lambda x: whole(x) & phrases.np.uint64(0x3FF << 31))
    body = pack(b" ".join(t.encode() for t, _ in rows if t))
    grams = phrases.Grams(body, "en", 3)
    assert len(set(grams.fingerprints(2, 33).tolist())) <= 1024
    f, _ = grams_by_hand(rows, 3)
    want = sorted((lang, k, p, c) for (lang, k, p), c in f.items() if c >= 10)
    got, _ = frequent_phrases(docs, 3, 10, bucket_bits=1)
    assert sorted(map(tuple, got.select("lang", "size", "phrase", "f").collect())) == want


def test_phrases_of_nothing(spark):
    assert collocations(table(spark, [(1, "a b")]).limit(0)).count() == 0
    assert collocations(table(spark, [(1, None), (2, " . ")])).count() == 0
    assert pack(b"") == b"" and pack(b"A  b,c\t d") == b"a b\nc d\n" and pack(b" x . . y") == b"x\ny\n"


# -- conversations ---------------------------------------------------------

COLUMNS = "conv_id long, turn long, role string, text string, node string, pos int, id string, a int, chars string, depth int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], COLUMNS)


def trie_by_hand(rows, shared=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = own
    if shared:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


def odd_conversations():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["hi", "Hi", "", None, "漢字", "x" * 5_000])) for c in [*range(0, 30), *range(100, 160), *range(-120, -100), 777] for t in range(r.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(3)]
    return rows + [(None, 1, "user", "lost"), (5, None, "user", "before all"), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (900, 0, None, None)]


@pytest.mark.parametrize("shared", [True, False])
def test_prefix_trie(spark, shared):
    rows = odd_conversations()
    got = prefix_trie(conversations(spark, rows).repartition(4), split=4, **({} if shared else {"rebuild": None}))
    assert sorted(map(tuple, got.collect()), key=repr) == trie_by_hand(rows, shared)


def test_prefix_trie_of_little(spark):
    empty = conversations(spark, [(1, 1, "a", "b")])
    assert prefix_trie(empty.limit(0)).count() == 0
    assert prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    # crc32("777") % 6 turns are taken from a conversation that isn't there.
    assert sorted(map(tuple, prefix_trie(conversations(spark, [(777, 1, "a", "b")])).collect()), key=repr) == trie_by_hand([(777, 1, "a", "b")])
    assert [(t.conv, t.pos, t.chars) for t in ordered_turns(conversations(spark, [(1, 2, "a", "漢字"), (1, None, None, None)])).orderBy("pos").collect()] == [(1, 1, 0), (1, 2, 2)]


def test_list_ranks(spark):
    """Several lists of uneven length, in shuffled order."""
    r, links, want = random.Random(2), [], {}
    at = 0
    for n in (1, 2, 300, 41):
        ids = [i * 7 % 1000 + 10_000 * at for i in range(n)]
        links += list(zip(ids, [*ids[1:], None]))
        want |= {x: n - 1 - i for i, x in enumerate(ids)}
        at += 1
    r.shuffle(links)
    got = list_ranks(Workspace(spark), spark.createDataFrame(links, "id long, next long"), split=8)
    assert {x.id: x.rank for x in got.collect()} == want
