import random

import pytest

from detlake.llm import leaks, pieces, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    e = tokens.encoder()
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


HARD = [
    None, "", " ", "\n\n \t x", "<|endoftext|>", "don't we'll I'd", "नमस्ते दुनिया। ठीक", "日本語のテキスト。次の文。", "👩‍👩‍👧 emoji ﬁ", "a" * 5000, "ab" * 3000, "aaab" * 999, "0123456789" * 300, "\u0000 ​", "x\r\ny",
    " ".join(["word"] * 3000), "=" * 4000, "\n" * 3000,
]


def test_ids_equal_a_public_encoder(reference):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abcé日本語 \n.,'09") for _ in range(rng.randrange(400))) for _ in range(200)]
    e = tokens.encoder()
    for t in texts:
        assert e.encode(t) == (reference.encode_ordinary(t) if t else [])


def test_splitters_equal_the_pattern():
    regex = pytest.importorskip("regex")
    want, (plain, mixed) = regex.compile(tokens.PATTERN).findall, tokens._splitters()
    rng = random.Random(8)
    ascii_ = "".join(map(chr, range(128)))
    some = ascii_ + "ab1 '''''  sstrvmld" * 6 + "\u00e9\u00df\u00c5\u00bd\u00b2\u0663\u65e5\u672c\u0915\u093f\u0301\u00a0\u2028\u3000\x85\U0001f44d\U0001d7d8\U00010400"
    for n in range(30_000):
        t = "".join(rng.choice(ascii_ if n % 3 == 0 else some) for _ in range(rng.randrange(14)))
        assert mixed(t) == want(t)
        assert not t.isascii() or plain(t) == want(t)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for t in ("".join(every), " ".join(every), "a".join(every[:70_000]), "1".join(every[:70_000]), ".".join(every[:70_000])):
        assert mixed(t) == want(t)


def test_queue_on_any_vocabulary():
    """Ranks in any order, so a merge may enable one of lower rank: against the plain rule."""
    rng = random.Random(5)
    for _ in range(60):
        words = {bytes([c]) for c in b"abc"}
        while len(words) < 14:
            words.add(rng.choice(sorted(words)) + rng.choice(sorted(words)))
        order = sorted(w for w in words if len(w) > 1)
        rng.shuffle(order)
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {w: 3 + i for i, w in enumerate(order)}
        data = bytes(rng.choice(b"abc") for _ in range(40))
        parts = [data[i : i + 1] for i in range(len(data))]
        while data not in ranks:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert tokens.RankQueue(ranks).encode(data) == ([ranks[data]] if data in ranks else [ranks[x] for x in parts])


def test_documents(spark, reference):
    rows = [(n, t, [1], "y") for n, t in enumerate(HARD)] + [(None, "null id", [], None), (3, "again", [], None), (3, "again", [], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, letters string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in tokens.encode_documents(df).collect())
    assert got == sorted((-1 if i is None else i, reference.encode_ordinary(t) if t else []) for i, t, *_ in rows)
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_pieces(spark, reference):
    rng = random.Random(2)
    prose = "\n\n".join(" ".join(f"Sentence {rng.randrange(999)} goes on, and on." for _ in range(rng.randrange(1, 30))) for _ in range(60))
    logs = "\n".join(f"{n:08d}ms frame={n} INFO class={n % 4}" for n in range(600))
    rows = [(n, t) for n, t in enumerate([*HARD, prose, logs, "दृश्य साफ़ है। " * 900, "路面に縦断ひび割れが見つかりました。" * 200, "क्षि" * 3000, "x" * 20000])]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, piece int, ends string")
    texts, got = dict(rows), {}
    for r in pieces.split_documents(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, t in rows if t and len(reference.encode_ordinary(t)) > 1024}
    assert {r.doc_id for r in pieces.split_found(df).collect()} == set(got)
    for i, parts in got.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and parts[0].begin == 0
        assert parts[-1].begin + parts[-1].tokens == len(reference.encode_ordinary(texts[i]))
        for r in parts:
            assert len(reference.encode_ordinary(r.text)) <= r.tokens <= 1024 and r.text in texts[i]
        for a, b in zip(parts, parts[1:]):
            assert 64 <= a.begin + a.tokens - b.begin <= 67
        joined = parts[0].text
        for r in parts[1:]:  # each next piece begins inside what is there and goes on from it
            k = next(k for k in range(len(r.text), 0, -1) if joined.endswith(r.text[:k]))
            joined += r.text[k:]
        assert joined == texts[i] or i in (9, 10, 11, 12, 15, 16, 17) or len(set(texts[i])) < 20
    assert all(r.text.endswith("\n") for r in sorted(got[len(HARD) + 1], key=lambda r: r.piece)[:-1])  # log lines stay whole
    assert all(r.text.endswith("\n\n") for r in sorted(got[len(HARD)], key=lambda r: r.piece)[:-1])


def test_other_limits(spark, reference):
    df = spark.createDataFrame([(1, "one two three. " * 50)], "doc_id long, text string")
    parts = pieces.split_documents(df, limit=40, overlap=8).collect()
    assert all(r.tokens <= 40 for r in parts) and len(parts) > 4
    with pytest.raises(ValueError):
        pieces.split_documents(df, limit=64, overlap=64)


def brute(docs, items):
    out = set()
    for d, t in docs:
        words = leaks.words_of(t)
        for i, s in items:
            want = leaks.words_of(s)
            n = min(12, len(want))
            if n and any(words[a : a + n] == want[b : b + n] for b in range(len(want) - n + 1) for a in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(n, " ".join(word() for _ in range(rng.choice((1, 2, 3, 5, 8, 11, 12, 13, 30))))) for n in range(60)] + [(60, ""), (61, "..."), (62, None), (63, "ﬁne Café ＡＢＣ１２")]
    docs = []
    for n in range(120):
        w = [word() for _ in range(rng.randrange(80))]
        source = leaks.words_of(rng.choice(items)[1])
        k = rng.randrange(len(source) + 1)
        w[5:5] = source[max(0, k - rng.randrange(9, 16)) : k]
        docs.append((n, rng.choice((" ", ", ", "\n- ")).join(w).upper()))
    docs += [(200, None), (201, ""), (202, "so fine café abc12 there"), (202, "so fine café abc12 there")]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, "s") for r in items], "item_id int, text string, doc_id string")
    want = brute(docs, items)
    assert (202, 63) in want
    got = [tuple(r) for r in leaks.leaked(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in leaks.leaked(d, i, filter_bits=6).collect()} == want  # a full map lets all pass, the join decides
    texts, passages = {n: leaks.words_of(t) for n, t in docs}, {n: leaks.words_of(t) for n, t in items}
    spans = leaks.spans(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in spans} == want
    for r in spans:  # equal and maximal
        a, b, n = texts[r.doc_id], passages[r.item_id], r.words
        assert n >= min(12, len(b)) and a[r.doc_begin : r.doc_begin + n] == b[r.item_begin : r.item_begin + n]
        assert r.doc_begin == 0 or r.item_begin == 0 or a[r.doc_begin - 1] != b[r.item_begin - 1]
        assert a[r.doc_begin + n : r.doc_begin + n + 1] != b[r.item_begin + n : r.item_begin + n + 1] or r.doc_begin + n == len(a)
    assert leaks.leaked(d, i.limit(0)).count() == 0 and leaks.leaked(d.limit(0), i).count() == 0


def test_every_shared_span_has_a_common_fingerprint():
    rng = random.Random(9)
    need, (k, window) = leaks.SPAN, leaks.plan(leaks.SPAN)
    for _ in range(200):
        span = [f"s{rng.randrange(9)}" for _ in range(need)]
        a = leaks.number([*(f"a{n}" for n in range(rng.randrange(9))), *span, "tail"])
        b = leaks.number([*(f"b{n}" for n in range(rng.randrange(9))), *span])
        assert set(leaks.winnow(leaks.grams(a, k), window)) & set(leaks.winnow(leaks.grams(b, k), window))


@pytest.mark.parametrize("alphabet, joint", [("道路点検記録縦断亀裂横断穴補修写真区間国県", ""), ("ひびわれてんけんきろくどうろしゃしん", ""), ("กขคงจฉชซฌญฎ", ""), ("abcdefgh", " "), ("सड़कदरारमरम", " ")])
def test_partial_leaks_are_found_in_every_script(spark, alphabet, joint):
    """Half of a passage inside other text of its script, without blanks where the script has none."""
    rng = random.Random(11)
    text = lambda n: joint.join(rng.choice(alphabet) * (1 if not joint else rng.randrange(1, 4)) for _ in range(n))
    items = [(n, text(44)) for n in range(20)]
    half = lambda t: joint.join(t.split(joint)[10:32]) if joint else t[10:32]
    docs = [(n, joint.join((text(30), half(t), text(30)))) for n, t in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.spans(d, i).collect()}
    assert {(n, n) for n, _ in items} <= found
