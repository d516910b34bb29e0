"""Chat round trip, prefix trie and tokenizer alignment against brute force on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pkgscreen.llm import alignment, chat, prefixtrie

TURNS = "conv_id long, turn long, role string, text string, h string, base string, whole string"
HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|im_start|>", "<", "<|", "|im_end|>", "<|nl|>", "\n", "<|im_end|", "", "é ß"]


def odd_turns(seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 38), 1000000000001, -7]:
        for t in range(rnd.choice([0, 1, 2, 4, 9, 12])):
            text = rnd.choice([f"say {rnd.randint(0, 2)}", "".join(rnd.choice(HOSTILE) for _ in range(rnd.randint(1, 5)))])
            rows.append((c, t, rnd.choice(["user", "assistant"]), text))
    for c in (40, 45, 46, 47):  # copies, deep enough for several rounds of doubling
        rows += [(c, t, "user", f"turn {t}") for t in range(30)]
    rows += [(50, None, "user", "before the first"), (50, 0, None, None), (50, 1, "as\nsistant", "x"), (50, 1, "as\nsistant", "x"), (51, 3, "<|nl|>", "y"), (51, 3, "<\\|im_end|>", "z" * 3000)]
    rows += [(60, t, "user", "same") for t in range(9)] + [(c, 0, "user", "same") for c in (61, 62, 63, 64)]
    rnd.shuffle(rows)
    return rows


def by_conversation(rows):
    out = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((r or "", x or ""))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    rows = odd_turns()
    return rows, spark.createDataFrame([(*r, "own", "own", "own") for r in rows], TURNS).repartition(5).cache()


def test_grammar_keeps_hostile_turns():
    rnd = random.Random(4)
    for _ in range(3000):
        made = [("".join(rnd.choice(HOSTILE) for _ in range(rnd.randint(0, 3))), "".join(rnd.choice(HOSTILE) for _ in range(rnd.randint(0, 6)))) for _ in range(rnd.randint(0, 3))]
        formatted = "".join(chat.settle(*t) for t in made)
        back = list(chat.parse(formatted))
        assert [t[:2] for t in back] == made
        assert all(chat.unescape(formatted[a:b]) == x for _, x, a, b in back)
    assert chat.settle("user", "plain < text") == "<|im_start|>user\nplain < text<|im_end|>\n"
    for wrong in ("x", "<|im_start|>user", "<|im_start|>a\nb<|im_end|>", "<|im_start|>a\n<|im_start|>b\nc<|im_end|>\n", "<|im_start|>a<|im_end|>\n\n"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(wrong))


def digests(rows):
    out = {}
    for c, own in by_conversation(rows).items():
        loss = "".join(x for r, x in own if r == "assistant")
        all_ = "".join(f"{r}\n{x}\n" for r, x in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(own), sha(all_), len(loss), sha(loss), sum(len(chat.settle(*t)) for t in own))
    return out


@pytest.mark.parametrize("part", [chat.PART_CHARS, 40])
def test_chat_reads_back_every_conversation(spark, turns, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows, table = turns
    rows = rows + [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    table = table.unionAll(spark.createDataFrame([(*r, "", "", "") for r in rows[-2:]], TURNS))
    got = {r.conv_id: tuple(r)[1:] for r in chat.round_trip(table).collect()}
    assert got == digests(rows)
    assert chat.round_trip(table.limit(0)).count() == 0


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"{t} <|im_end|>") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format(table).cache()
    assert formatted.select("range").distinct().count() > 1
    got = [tuple(r)[1:] for r in chat.read_back(formatted).collect()]
    assert got == [digests(rows)[7]]
    rows = [(c, t, r, x) for _, t, r, x in rows[:400] for c in (5, 6)]  # both over several ranges
    table = spark.createDataFrame(rows, table.schema)
    assert sorted(tuple(r) for r in prefixtrie.trie(table).collect()) == brute_trie(rows)


def brute_trie(rows):
    own = by_conversation(rows)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    out = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if kids[node] else 1
        for kid in kids[node]:
            leaves, saved = leaves + out[kid][5], saved + out[kid][6]
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


@pytest.mark.parametrize("chunk", [prefixtrie.CHUNK_CHARS, 2])
def test_trie_against_brute_force(spark, turns, monkeypatch, chunk):
    monkeypatch.setattr(prefixtrie, "CHUNK_CHARS", chunk)
    rows, table = turns
    # ties by content hash: leave one row of each tie
    rows = [r for r in rows if r[0] not in (50, 51)] + [(50, None, "user", "before the first"), (50, 0, None, None), (50, 1, "as\nsistant", "x"), (50, 1, "as\nsistant", "x")]
    table = spark.createDataFrame([(*r, "own", "own", "own") for r in rows + [(None, 0, "user", "no id")]], TURNS)
    got = sorted(tuple(r) for r in prefixtrie.trie(table).collect())
    assert got == brute_trie(rows)
    assert prefixtrie.trie(table.limit(0)).count() == 0


def test_trie_notices_and_leaves_collisions(spark, turns, monkeypatch):
    rows = [r for r in turns[0] if r[0] not in (50, 51)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    salts = []

    def weak(salt):
        salts.append(salt)
        return [1] * prefixtrie.LANES if salt == 0 else bases(salt)  # base 1: the order of turns is lost

    bases = prefixtrie.bases
    monkeypatch.setattr(prefixtrie, "bases", weak)
    more = [(70, 0, "user", "p"), (70, 1, "user", "q"), (71, 0, "user", "q"), (71, 1, "user", "p"), (76, 0, "user", "p"), (76, 1, "user", "q")]
    swapped = [(c, t, "user", x) for c in (200, 300) for t, x in enumerate("pq" * 8 if c == 200 else "qp" * 8)]
    table = table.unionAll(spark.createDataFrame(more + swapped, table.schema))
    assert sorted(tuple(r) for r in prefixtrie.trie(table).collect()) == brute_trie(rows + more + swapped)
    assert len(salts) > 1


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as own
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(own.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=own.path("piece_bpe_32k.model"))


def brute_alignment(texts, libraries):
    a, b = libraries
    signs = alignment._byte_signs()
    rows, docs = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(signs[c] for c in a.id_to_token(i)) if i != 50256 else b"?" for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            rows.append(None)
            continue
        ea, eb = np.cumsum(list(map(len, ta))).tolist(), np.cumsum(list(map(len, tb))).tolist()
        links, i, j = [], 0, 0
        while i < len(ea) and j < len(eb):
            links.append((ia[i], ib[j]))
            i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
        groups, ga, gb, i, j = [], [], [], 0, 0
        for cut in sorted({*ea} | {*eb}):
            if i < len(ea) and ea[i] == cut:
                ga.append(ia[i])
                i += 1
            if j < len(eb) and eb[j] == cut:
                gb.append(ib[j])
                j += 1
            if i and j and ea[i - 1] == eb[j - 1]:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        rows.append((ia, ib, groups, links))
        docs.update(set(links))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    for row in rows:
        if row is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            ia, ib, groups, links = row
            yield len(ia), len(ib), len(groups), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()


def alignment_texts():
    rnd = random.Random(9)
    bits = ["the", "Straße", " ", "  ", "\n", "\t", "🙂", "<|endoftext|>", "</s>", "中文字", "it's", "1234", "é", " ", "▁", "　", "...", "antidis", " ", "\x00"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(150)]
    plain = [" ".join(rnd.choice(["the", "and", "alignment", "tokens,", "of", "Größe", "naïve"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return made + plain + [None, "", " ", "a", "same text", "same text", " " * 300 + "x", "x" * 5000, ("word after word " * 4000).strip()]


@pytest.mark.parametrize("limits", [{}, {"PART_CHARS": 50, "SLICE_BYTES": 200, "WORDS_BYTES": 2000, "BLOCK_PAIRS": 300, "CHUNK": 7}])
def test_alignment_against_brute_force(spark, libraries, limits):
    texts = alignment_texts()
    kept = {k: getattr(alignment, k) for k in limits}
    try:
        for k, v in limits.items():
            setattr(alignment, k, v)
        own = alignment.aligner(alignment.VOCABULARY_A, alignment.RANKS_A, alignment.VOCABULARY_B)
        for text in texts:  # the parts of one text at a time, in this process
            if text:
                rows, per = alignment._aligned(own, *next(alignment._slices([text])))
                want = next(brute_alignment([text], libraries))
                if want[0]:
                    assert tuple(rows[0][c] for c in alignment.COUNTS) == want[:4] and rows[0]["sha"].hexdigest() == want[6]
                    assert sum(per["count_all"].to_pylist()) == want[3]
                else:
                    assert not rows and not per.num_rows
    finally:
        for k, v in kept.items():
            setattr(alignment, k, v)
    if not limits:
        table = spark.createDataFrame([(i if i % 50 else None, t, "own", "own") for i, t in enumerate(texts)], "doc_id long, text string, block string, pair string").repartition(3)
        got = alignment.align(table).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(map(tuple, got.collect())) == sorted(brute_alignment(texts, libraries))
        assert {r.doc_id for r in alignment.align(table).collect()} == {i if i % 50 else None for i in range(len(texts))}
        assert alignment.align(table.limit(0)).count() == 0


def test_blocks_of_aligned_documents_stay_small():
    """One group of the last step holds about a million pairs, however many a task's documents have."""
    import random

    import pyarrow as pa

    from pkgscreen.llm import alignment

    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=400)) for _ in range(5000)]
    held: dict[str, int] = {}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for out in alignment._aligning((alignment.VOCABULARY_A, alignment.RANKS_A, alignment.VOCABULARY_B), pa.int64())(iter([batch])):
        for block, kind, x in zip(out["block"].to_pylist(), out["kind"].to_pylist(), out["held"].to_pylist()):
            held[block] = held.get(block, 0) + (len(x) // 4 if kind == "docs" else 0)
    assert sum(held.values()) > 2 << 20 and max(held.values()) < 3 << 20


def test_pieces_are_decoded_together():
    """Byte pieces, unknown ids and texts without ids among others, against the model."""
    import numpy as np

    from pkgscreen.llm import pieces

    vocab = pieces.vocabulary()
    texts = ["", "plain words", "  two  blanks ", "一龥 \U0001F600 x", "a▁b", "tab\tand\nline", "กำ" * 40, "z" * 500]
    ids = vocab.encode_all(texts)
    assert vocab.decode_all(ids) == [vocab.model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
    cut = np.array([vocab.byte[0xE4], vocab.byte[0xB8]], "<u4").tobytes()  # a character broken off
    assert vocab.decode_all([cut, np.array([10**7], "<u4").tobytes(), ids[1]]) == [cut and b"\xe4\xb8".decode("utf-8", "replace"), "", "plain words"]
    assert vocab.decode_all([]) == []
