"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from candlewick.llm import bpe, caps, langid, lm, media, minhash, mixing, quality, quotes, tokenshards
from candlewick.llm.queries import ORACLES, QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a\x1cb \x85c ΑΣ Σ é İ it's <|endoftext|>x<|startoftext|> 日本語 123 é ﬁ   x", "' 's'S", "word " * 5000, "one", "one", "…—", "ÀÉ" * 300]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i if i else None, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", i) for i, t in enumerate(ODD)]
    rows += [rows[3], (3, "another text under an id that is there", "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit(1), "u": F.lit("x"), "key": F.lit(2), "words": F.lit(3), "row": F.lit(0), "score": F.lit(9.0), "bucket": F.lit(5)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def rows_of(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1: token shards -------------------------------------------------------------------------


def expected_shards(tokenizer, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_hold_all_ids_in_order(docs, tokenizer):
    got = sorted(tuple(r) for r in tokenshards.op1(docs, TOKENIZER).collect())
    assert got == expected_shards(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])


def test_shards_of_odd_rows(odd, empty, tokenizer):
    got = sorted((tuple(r) for r in tokenshards.op1(odd, TOKENIZER).collect()), key=lambda r: r[1])
    want = expected_shards(tokenizer, [(r.doc_id, r.text) for r in odd.collect()])
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, n, c) for i, _, n, c in want)
    assert [s for _, s, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in got])[:-1]]).tolist()
    assert [i for i, *_ in got] == [i for i, *_ in want]
    assert tokenshards.op1(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_repeated_keys_over_many_shards(spark, tokenizer, share, monkeypatch):
    """Read whole or in ranges; a key has an entry a shard."""
    monkeypatch.setattr(tokenshards, "SHARD_BYTES", 64)
    monkeypatch.setattr(tokenshards, "GOOD_PART", share)
    rows = [(7, f"word {k % 5} and more") for k in range(60)] + [(k, "x " * k) for k in range(20)]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenshards.op1(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect())
    want = expected_shards(tokenizer, rows)
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, n, c) for i, _, n, c in want)
    ends = [s + n for _, s, n, _ in got]
    assert [s for _, s, _, _ in got] == [0, *ends[:-1]]


def test_ids_of_a_tokenizer_that_keeps_white_space(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "two  spaces and\na line"), (2, " lead"), (3, None)]
    got = {r.doc_id: r.n_tokens for r in tokenshards.op1(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    t = Tokenizer.from_file(path)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}


def odd_texts():
    rng = np.random.default_rng(8)
    near = [chr(k) for k in [*range(0x300), *range(0x2000, 0x2070), 0x3A3, 0x1E9E, 0x212A, 0xFB01, 0x10FFFF]]
    texts = [f"x{c}y {c} {c}s {c}'T{c} '{c}9{c}{c}. O{c}\u0301" for c in near]
    plain = [*"abSTREVML's.,!0'1 ", "\t", "\n", "\u00e9", "\u00c9", "\u0178", "\u017f", "\u2019", "\u2013"]
    texts += ["".join(rng.choice(plain, rng.integers(0, 40))) for _ in range(600)]
    return [*texts, "", " ", "a<|endoftext|>b", "<|ENDOFTEXT|> a", "</w> a</w>b", "\u0130I\u0131", "w" * 3000]


@pytest.mark.parametrize("cut", ["as is", "piece by piece", "by word"])
def test_pieces_of_odd_texts_equal_the_library(tokenizer, cut):
    enc, texts = tokenshards.WordIds(TOKENIZER), odd_texts()
    if cut == "piece by piece":
        enc.closes[:] = False
    elif cut == "by word":
        enc.by_piece = False
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, enc.kind).tolist() for k in range(0, len(texts), 90) for x in enc.encode_batch(texts[k : k + 90])] == want


def test_words_that_differ_by_case_and_marks_go_through_the_library_once(tokenizer):
    class Counted:
        sent = 0

        def encode_batch_fast(self, texts, **options):
            self.sent += sum(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    words = [f"{a}{b}{c}" for a in ("lor", "Vel", "\u00e9t") for b in ("em", "ip", "os") for c in ("um", "ia", "ent")]
    texts = [" ".join(f(w) + m for w in words) for f in (str.lower, str.upper, str.title) for m in ("", ".", ",", "!!")]
    enc = tokenshards.WordIds(TOKENIZER)
    enc.tokenizer = counted = Counted()
    got = [np.frombuffer(x, enc.kind).tolist() for _ in range(2) for x in enc.encode_batch(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] * 2
    assert counted.sent < 2 * sum(len(w) for w in words)


@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_perfect_hash(n):
    shift, slot = tokenshards.perfect_hash(tokenshards.key_hash(list(range(n))))
    assert sorted(slot) == list(range(n))
    index = tokenshards.Index(tokenshards.build(list(range(n)), [[(k, 1, 2, 3)] for k in range(n)]))
    assert [e[0][0] for e in index.find(list(range(n)))] == list(range(n))
    assert sum(len(e) for e in index.find([10**12 + k for k in range(n)])) <= 1
    texts = tokenshards.Index(tokenshards.build(["a", "b", None], [[(1, 0, 0, 0)], [(2, 0, 0, 0), (3, 0, 0, 0)], [(4, 0, 0, 0)]]))
    assert [e[:, 0].tolist() for e in texts.find(["b", None, "a"])] == [[2, 3], [4], [1]]


# -- 2: media --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 600_000])
def test_media_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(rng.choice([*"some plain text, é".encode()], n).astype(np.uint8)), bytes(n)):
        wide, high, pixels = media.thumbnail(media.store(data))
        assert media.BYTES[pixels].tobytes() == media.padded(data) and wide == 512 and high == 8 * len(media.padded(data)) // 64
    files = [media.store(bytes(rng.integers(0, 256, k, dtype=np.uint8))) for k in (n, 700, 0, 20_000)]
    assert all(np.array_equal(a[2], media.thumbnail(f)[2]) for a, f in zip(media.thumbnails(files), files, strict=True))


def test_levels_and_tables():
    assert sorted(media.LEVELS) == list(range(256)) and (media.BYTES[media.LEVELS] == np.arange(256)).all()
    assert all(sum(2.0**-k for k in p) <= 1 - 2.0 ** -max(p) for p in media.PROFILES)  # no code of ones only


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


DC, AC = {0: "00", 3: "01", 5: "10"}, {0x00: "0", 0x03: "10", 0xF0: "110"}


def number(v, s):
    return format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""


def coded(d):
    """A block of DC difference d, one long run of zeros and one AC coefficient."""
    s = abs(d).bit_length()
    return DC[s] + number(d, s) + AC[0xF0] + AC[0x03] + "101" + AC[0]


def huffman(tc, codes):
    return media.segment(0xC4, bytes([tc]) + bytes(sum(len(c) == n for c in codes.values()) for n in range(1, 17)) + bytes(codes))


QUANT = media.segment(0xDB, b"\0" + b"\x08" * 64)
COLOUR = [QUANT, media.segment(0xC0, b"\x08\0\x10\0\x20\3\1\x22\0\2\x11\0\3\x11\0"), huffman(0, DC), huffman(0x10, AC)]
UNITS = [[5, -4, 20, 0, 7, -7], [-6, 0, 4, 0, 0, 0]]


def test_general_decoder_reads_colour_with_ac_and_restarts():
    """Two units of 2 x 2 luminance and two chroma blocks, AC coefficients, a restart between the units."""
    scan = b"\xff\xd0".join(bits_to_scan("".join(map(coded, u))) for u in UNITS)
    body = [*COLOUR, media.segment(0xDD, b"\0\1"), media.segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")]
    wide, high, pixels = media.thumbnail(b"\xff\xd8" + b"".join(body) + scan + b"\xff\xd9")
    assert (wide, high) == (32, 16)
    assert pixels.tolist() == [[133, 129, 122, 122], [149, 149, 126, 126]]


def test_one_scan_a_component_and_fill_bytes():
    """The luminance comes first, then the chroma scans under other tables; fill bytes before markers."""
    scans = [(1, [5, -4, 20, 0, -6, 0, 4, 0]), (2, [7, 0]), (3, [-7, 0])]
    other = {0: "1", 3: "01", 5: "001"}
    data = b"\xff\xd8" + b"\xff\xff\xff".join([b"", *(x[1:] for x in COLOUR)])
    for part, diffs in scans:
        if part == 2:
            data += b"\xff\xff" + huffman(0, {k: other[k] for k in sorted(other, key=lambda k: len(other[k]))})[1:]
        bits = "".join(coded(d) if part == 1 else other[abs(d).bit_length()] + number(d, abs(d).bit_length()) + AC[0] for d in diffs)
        data += media.segment(0xDA, bytes([1, part, 0, 0, 0x3F, 0])) + bits_to_scan(bits)
    assert media.thumbnail(data + b"\xff\xff\xd9")[2].tolist() == [[133, 129, 149, 149], [143, 143, 147, 147]]


@pytest.mark.parametrize("broken", ["flip", "short", "precision", "progressive", "no code", "left over"])
def test_broken_files_are_refused(broken):
    scan = b"\xff\xd0".join(bits_to_scan("".join(map(coded, u))) for u in UNITS)
    body = b"".join([*COLOUR, media.segment(0xDD, b"\0\1"), media.segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")])
    if broken == "flip":
        scan = scan[:1] + bytes([scan[1] ^ 0xFE]) + scan[2:]
    elif broken == "short":
        scan = scan[:-6]
    elif broken == "precision":
        body = body.replace(b"\xff\xc0\0\x11\x08", b"\xff\xc0\0\x11\x0c")
    elif broken == "progressive":
        body = body.replace(b"\xff\xc0", b"\xff\xc2")
    elif broken == "no code":
        scan = b"\xfe" * len(scan)
    elif broken == "left over":
        scan += b"\0\0\0"
    with pytest.raises(ValueError):
        media.thumbnail(b"\xff\xd8" + body + scan + b"\xff\xd9")


def test_media_query(odd, empty):
    for r in media.op2(odd.select("doc_id", "text")).join(odd.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 3").collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.op2(odd).count() == odd.count() and media.op2(empty).count() == 0
    with pytest.raises(ValueError):
        media.thumbnail(media.store(b"x" * 500)[:-40])


# -- 3: quotation linking --------------------------------------------------------------------


def test_quotes_link_and_order(spark):
    m = [(1, 0, "u", "Hello  World\n\nSecond para here"), (1, 1, "a", "Bob wrote:\n> hello world\nYes indeed."), (1, 2, "u", "> Yes indeed.\nOK then"), (1, 3, "u", "> > hello world\n> yes INDEED.\nfine"), (1, 4, "x", None), (None, 0, "u", "> a\nb"), (2, None, "u", "q"), (1, 5, "u", "> Second para here\n>\nnot it"), (1, 2, "u", "> Yes indeed.\nOK then")]
    got = quotes.conversations(spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)))
    one = [(r.turn, r.text, r.n_linked, r.parent_turn, r.depth) for r in got.where("conv_id = 1").orderBy("position").collect()]
    assert one == [(0, "Hello  World\n\nSecond para here", 0, None, 0), (1, "Yes indeed.", 1, 0, 1), (5, "not it", 1, 0, 1), (2, "OK then", 1, 1, 2), (2, "OK then", 1, 1, 2), (3, "fine", 2, 1, 2), (4, "", 0, None, 0)]
    assert [r.position for r in got.where("conv_id = 1").orderBy("position").collect()] == list(range(1, 8))
    assert got.count() == len(m) and quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_reply_chains(spark):
    rows = [(7, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [(r.turn, r.depth, r.root_turn) for r in got] == [(i, i, 0) for i in range(40)]


def test_replies_between_quotes_and_trimmed_quotes_link(spark):
    quote = lambda t: "\n".join(f"> {x}" for x in t.split("\n"))
    rows = [
        (1, 0, "first one\nsecond one\nthird one\n\nnew para"),
        (1, 1, "a\nb\n> first one\nc\nd"),
        (1, 2, f"{quote('a' + chr(10) + 'b')}\nyes\n{quote('c' + chr(10) + 'd')}\nno"),
        (1, 3, "> first one\n> second one\ntwo of three lines"),
        (1, 4, "second one\nthis here"),
        (1, 5, "> second one\n> third one\nthe latest with both is turn 0"),
        (1, 6, "> second one\n> this here\n> third one\nno turn has all of it"),
        (1, 7, "p one\np two\n\nq one\nq two\n\nr one\nr two"),
        (1, 8, "> p one\n> p two\n>\n> r one\n> r two\ntwo of three paragraphs"),
    ]
    got = quotes.conversations(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.n_linked, r.parent_turn) for r in got] == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 1, 0), (4, 0, None), (5, 1, 0), (6, 0, None), (7, 0, None), (8, 1, 7)]


def brute_conversations(rows):
    """parent turn, n_linked, depth, root and order of (turn, text) rows with distinct turns of one conversation."""
    import re

    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    split = {}
    for turn, text in rows:
        lines = []
        for x in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]?>)+)[ \t]?", x)
            lines.append((m[1].count(">") if m else 0, x[m.end() :] if m else x))
        runs = []
        for level, body in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        split[turn] = [(level, "\n".join(body)) for level, body in runs]
    offers = {}
    for turn, runs in split.items():
        own = [b for level, b in runs if level == 0]
        whole = "\n".join(own).strip(" ")
        if whole == "":
            offers[turn] = set()
            continue
        units = [whole, *own, *re.split(r"\n\s*\n", whole), *(p for b in own for p in re.split(r"\n\s*\n", b)), *whole.split("\n")]
        offers[turn] = {norm(u) for u in units} - {""}
    parent, linked = {}, {}
    for turn, runs in split.items():
        up, n = [], set()
        for level, body in runs:
            if level == 0 or not norm(body):
                continue
            for parts in ([body], re.split(r"\n\s*\n", body), body.split("\n")):
                need = {norm(p) for p in parts} - {""}
                to = max((t for t in offers if t < turn and need <= offers[t]), default=None)
                if need and to is not None:
                    n.add((level, norm(body)))
                    if level == 1:
                        up.append(to)
                    break
        parent[turn], linked[turn] = max(up, default=None), len(n)
    out = {}
    for turn in split:
        depth, at = 0, turn
        while parent[at] is not None:
            depth, at = depth + 1, parent[at]
        out[turn] = (linked[turn], parent[turn], at, depth)
    order = sorted(split, key=lambda t: (out[t][2], out[t][3], t))
    return {t: (*out[t], order.index(t) + 1) for t in split}


def test_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 2)
    rng, rows, convs = np.random.default_rng(12), [], {}
    for c in range(6):
        texts = []
        for turn in range(30):
            own = [f"line {rng.integers(0, 12)} of {c}" for _ in range(rng.integers(1, 5))]
            if rng.random() < 0.3:
                own.insert(int(rng.integers(0, len(own))), "")
            text = "\n".join(own)
            if turn and rng.random() < 0.7:
                lines = texts[int(rng.integers(0, turn))].split("\n")
                a = int(rng.integers(0, len(lines)))
                quote = [f"> {x}" if not x.startswith(">") else f">{x}" for x in lines[a : a + int(rng.integers(1, 5))]]
                text = "\n".join([*quote, text])
            texts.append(text)
        convs[c] = list(enumerate(texts))
        rows += [(c, t, "u", x) for t, x in convs[c]]
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_turn, r.root_turn, r.depth, r.position) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert got == {(c, t): v for c in convs for t, v in brute_conversations(convs[c]).items()}
    assert sum(v[0] for v in got.values()) > 40


def test_quotes_of_odd_rows(spark):
    long = "\n".join(f"> {k}" if k % 2 else f"own {k}" for k in range(4000))
    rows = [(1, 0, "u", long), (1, 0, "u", long), (1, None, None, None), (None, None, None, ""), (None, 1, "u", "> x"), (1, 1, "u", ">" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("slot", "part", "tie", "position", "hash", "cell")})
    got = quotes.conversations(df).collect()
    assert sorted((r.conv_id is None, r.position) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 1), (True, 2)]


# -- 4: language model -----------------------------------------------------------------------


def test_language_model(docs):
    got = {r.doc_id: r for r in lm.op4(docs).collect()}
    count, ends = Counter(), 0
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(r.text.encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for r in docs.collect():
        words, g = r.text.encode().lower().split(), got[r.doc_id]
        base = sum(np.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in words), ends])
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.train_tokens == n
        assert (g.n_tokens, g.n_known) == (len(words) + 1, sum(count[w] > 0 for w in words) + 1)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    some = [g for g in got.values() if g.held_out]
    bits = [-sum(x) / np.log10(2) / sum(g.n_tokens for g in some) for x in ([g.score for g in some], [g.base_score for g in some])]
    assert bits[0] < bits[1] - 0.04, bits  # 200 documents of invented prose; on 10,000 the margin is 1.29 bits a token


def small_model():
    words = lm.Words(n=50, v=10, ends=5)
    p = lm.start_weights(words)
    return words, p


def test_state_is_carried_over_windows_and_lanes():
    words, p = small_model()
    rng = np.random.default_rng(0)
    n = np.array([0, 3, 100, 31, 32, 33])
    sym = rng.integers(1, words.symbols, n.sum())
    got, first = lm.log_scores(p, words, sym, n), np.concatenate([[0], np.cumsum(n)])
    cls = words.class_of(np.arange(words.symbols))
    for k in range(len(n)):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        own = sym[first[k] : first[k + 1]]
        for before, goal in zip([0, *own], [*own, 0], strict=True):
            x, m = p["E"][before] @ p["W"] + p["b"], lm.HIDDEN
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * m] + h @ p["U"][:, : 2 * m]))), 2, axis=1)
            h = (1 - z) * h + z * np.tanh(x[2 * m :] + (r * h) @ p["U"][:, 2 * m :])
            total += float(lm.predicted(p, h, cls[[goal]], np.array([(goal - 1) % lm.MEMBERS]))[0])
        assert got[k] == pytest.approx(total, rel=1e-4)


def test_words_of_a_chunk_equal_plain_splitting():
    import xxhash

    rng = np.random.default_rng(9)
    texts = [b"", b" ", b"\x0b\x0cA \x85B\xff\x00c\x1cD\t\n", "ÀÉ É\u00a0x".encode(), b"one", b"one", b"x" * 9000]
    texts += [bytes(rng.choice([*b"aBZz@[ \t\n\x0b\x0c\r\x1c\x85\xff\x00"], rng.integers(0, 50)).astype(np.uint8)) for _ in range(300)]
    n, tokens, uniq, ending = lm.hashed(texts)
    split = [t.lower().split() for t in texts]
    assert n.tolist() == [len(ws) for ws in split] and (uniq[1:] > uniq[:-1]).all()
    words = [w for ws in split for w in ws]
    assert uniq[tokens].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert ending[tokens].tolist() == [int.from_bytes(w[-2:], "little") for w in words]


def test_logits_come_as_many_rows_at_a_time_as_a_cache_holds(monkeypatch):
    words, p = small_model()
    rng, seen, logits = np.random.default_rng(3), [], lm.logits
    monkeypatch.setattr(lm, "logits", lambda h, *rest: seen.append(len(h)) or logits(h, *rest))
    docs = [rng.integers(1, words.symbols, 200) for _ in range(300)]
    tokens, loss = lm.train_whole(lm.Adam(p), docs, words.class_of(np.arange(words.symbols)), 0.0)
    score = lm.log_scores(p, words, np.concatenate(docs), np.full(300, 200))
    assert tokens == 300 * 201 and loss == pytest.approx(-score.sum(), rel=1e-4)
    assert max(seen) <= 1024


def test_gradient():
    words, p = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(1)
    lane = rng.integers(0, words.symbols, (5, 3))
    cls, mask, h = words.class_of(np.arange(words.symbols)), rng.random((4, 3)) < 0.8, np.zeros((3, lm.HIDDEN))
    loss = lambda q: lm.window_gradient(q, lane[:-1], lane[1:], mask, h, cls)[2] / mask.sum()
    g, _, _ = lm.window_gradient(p, lane[:-1], lane[1:], mask, h, cls)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[k][at], rel=1e-2)


def test_training_reads_every_token_with_the_state_carried_on():
    words, p = small_model()
    rng = np.random.default_rng(2)
    n = np.concatenate([[0, 1, 31, 32, 33, 64, 5000], rng.integers(0, 200, 400)])
    sym = rng.integers(1, words.symbols, n.sum())
    cls = words.class_of(np.arange(words.symbols))
    docs = np.split(sym, np.cumsum(n)[:-1])
    tokens, loss = lm.train_whole(lm.Adam(p), docs, cls, 0.0)
    assert tokens == n.sum() + len(n)
    assert loss == pytest.approx(-lm.log_scores(p, words, sym, n).sum(), rel=1e-4)
    opt = lm.Adam(p)
    lm.train_whole(opt, docs, cls, 0.002)
    assert lm.train_whole(lm.Adam(opt.p), docs, cls, 0.0)[1] < loss


def test_counts_by_shelf_equal_counts_at_once(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    rows = docs.select("doc_id", F.lit(True).alias("train"), F.col("text").cast("binary").alias("text"))
    chunks = lm.written(lm.chunked(rows), "chunks")
    assert chunks.count() > 10
    for bits in (0, 2):
        one, tree = ({(r.part, r.chunk): tuple(r)[2:] for r in lm.counted(chunks, bits, shelves).collect()} for shelves in (1, 3))
        assert one == tree


def test_averages_meet_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lm, "MERGED", 3)
    rows = [(k, k + 1, np.full(4, k, "<f4").tobytes()) for k in range(11)]
    got = lm.averaged(spark.createDataFrame(rows, "part int, tokens long, weights binary"), 11)
    assert len(got) <= 3 and sum(r.tokens for r in got) == 66
    assert sum(np.frombuffer(bytes(r.weights), "<f4") * r.tokens / 66 for r in got) == pytest.approx(sum(k * (k + 1) for k in range(11)) / 66, rel=1e-6)


@pytest.mark.parametrize("kind", ["short", "decimal(20,0)", "string"])
def test_ids_of_any_type(docs, kind):
    some = docs.limit(40).withColumn("doc_id", F.col("doc_id").cast(kind))
    assert {r.doc_id for r in lm.op4(some).collect()} == {r.doc_id for r in some.collect()} == {r.doc_id for r in minhash.components(some).collect()}


def test_language_model_of_odd_rows(odd, empty):
    got = lm.op4(odd).collect()
    assert len(got) == odd.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert lm.op4(empty).count() == 0


# -- 5: mixing -------------------------------------------------------------------------------


def expected_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    stop = {s: 3.0 * sizes[s] for s in names}
    target, left, live = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and live:
        total = sum(w[s] for s in live)
        more = {s: left * w[s] / total for s in live}
        left = 0.0
        for s in list(live):
            target[s] += more[s]
            if target[s] > stop[s]:
                left += target[s] - stop[s]
                target[s] = stop[s]
                live.discard(s)
    return target


def test_mixing_targets_and_copies(spark, docs):
    lop = docs.withColumn("source", F.when(F.col("doc_id") % 5 < 3, "big").when(F.col("doc_id") % 5 == 3, F.concat(F.lit("s"), F.col("doc_id") % 7)))
    for df in (docs, lop):
        got = mixing.op5(df).join(df.select("doc_id", "source"), "doc_id").collect()
        size, taken, target = Counter(), Counter(), {}
        for r in got:
            size[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        assert target == pytest.approx(expected_targets(size))
        for s in size:
            assert abs(taken[s] - target[s]) <= max(0.02 * target[s], max(r.size for r in got if r.source == s) / 2)
        assert rows_of(mixing.op5(df)) == rows_of(mixing.op5(df.repartition(7)))


def expected_copies(spark, df):
    """Copies by (doc_id, source, size, u) from the definition: whole copies, then rank after rank to the nearest row."""
    rows = [tuple(r) for r in mixing.sized(df).collect()]
    size = Counter()
    for _, s, n, _ in rows:
        size[s] += n
    out = Counter()
    for s, target in expected_targets(size).items():
        mine = [r for r in rows if r[1] == s]
        whole = int(target / size[s] + 1e-9) if size[s] else 0
        rest = max(0.0, target - whole * size[s])
        f = min(1 - 1e-9, max(1e-9, target / size[s] - whole)) if size[s] else 0
        live = [r for r in mine if r[2] > 0]
        odds = lambda r: f / (1 - f) * (r[2] * len(mine) / size[s]) ** mixing.TILT
        live.sort(key=lambda r: (r[3] / (1 - r[3]) / odds(r), r[2], r[0]))
        for r in live:
            out[r] += whole
        run = 0
        for r in live if rest else []:
            if run + r[2] / 2 > rest:
                break
            out[r] += 1
            run += r[2]
    return out


def test_mixing_ranks_equal_brute_force(spark, docs):
    lop = docs.withColumn("source", F.when(F.col("doc_id") % 5 < 3, "big").when(F.col("doc_id") % 5 == 3, F.concat(F.lit("s"), F.col("doc_id") % 7)))
    for df in (docs, lop):
        taken, got = expected_copies(spark, df), Counter()
        for r in mixing.mix(df).collect():
            got[(r.doc_id, r.source)] += r.copies
        want = Counter()
        for (i, s, _, _), k in taken.items():
            want[(i, s)] += k
        assert +got == +want


def test_mixing_takes_some_of_many_equal_rows(spark):
    text = "a b c d"
    rows = [(1, text, "x")] * 100 + [(2, text, "y")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for got in (mixing.op5(df), mixing.op5(df.repartition(3))):
        by = {r.doc_id: (r.target, r.taken) for r in got.groupBy("doc_id").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
        assert all(abs(taken - target) <= 2 for target, taken in by.values()) and by[1][0] == pytest.approx(800 * 5 / 7)
    assert mixing.mixed(df).count() == sum(t for _, t in by.values()) / 4


def test_mixed_rows_keep_their_columns(odd, empty):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    taken = {(r.doc_id, r.size): r.taken for r in mixing.op5(odd).collect()}
    assert len(taken) > 5 and out.count() == sum(int(r.copies) for r in mixing.mix(odd).collect())
    assert mixing.op5(empty).count() == 0 and mixing.mixed(empty).count() == 0


# -- 6: near-duplicates ----------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=60):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(400)]
    out = [(1000 + k, " ".join(base)) for k in range(5)]
    for k in range(n):  # a chain: each differs from the one before by a little, from the first by much
        for at in rng.integers(0, 400, 3):
            base[at] = f"x{k}-{at}"
        out.append((2000 - k, " ".join(base)))
    return [*out, (1, "a b c"), (2, "A B c"), (3, "a b c d"), (4, ""), (5, None), (6, "one"), (7, "one")]


@pytest.mark.parametrize("tile", [minhash.TILE, 16])
def test_components_equal_brute_force(spark, docs, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = near_copies() + [(10_000 + r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (n, component) in brute_components(rows).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, i == component)


def test_bounds_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(200, len(pool)), replace=False)) for _ in range(2))
        x, y = minhash.sketch(a), minhash.sketch(b)
        size = min(len(x), len(y))
        d = int(np.bitwise_count(minhash.folded(x, size) ^ minhash.folded(y, size)).sum())
        assert d <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert minhash.may_link(len(a), len(b), d) or not minhash.links(a, b)


@pytest.mark.parametrize(("scheme", "least"), [(minhash.AT_85, 0.85), (minhash.AT_80, 0.8)])
def test_near_pairs_share_a_bucket(scheme, least):
    rng = np.random.default_rng(13)
    for k in range(1500):
        n = int(rng.integers(7, 400))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))[: n + n // 4 + 1]
        rng.shuffle(pool)
        extra = int(n * (1 - least) / (1 + least))  # each side's own members, at the threshold
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[extra:n], pool[n : n + extra]]))
        assert minhash.links(a, b, scheme)
        assert set(minhash.buckets(minhash.signature(a, scheme), scheme).tolist()) & set(minhash.buckets(minhash.signature(b, scheme), scheme).tolist()), k


def test_components_of_odd_rows(odd, empty):
    got = minhash.components(odd).collect()
    assert len(got) == odd.count() and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (6, 7)} == {(6, 6), (7, 6)}
    assert minhash.components(empty).count() == 0


# -- 7: near-duplicate vectors ---------------------------------------------------------------


def brute_links(rows):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, root = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (a, la, u) in enumerate(ok):
        for b, lb, w in ok[x + 1 :]:
            if la == lb and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.98:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("tile", [caps.TILE, 8])
def test_vector_links_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(caps, "TILE", tile)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            x = rng.standard_normal(64)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((i, [float(v) for v in np.float32(x + rng.standard_normal(64) * rng.choice([0, 0.08, 0.14]))], label))
                i += 1
    x, away = rng.standard_normal(64), rng.standard_normal(64)
    away -= (away @ x) / (x @ x) * x
    away *= np.linalg.norm(x) / np.linalg.norm(away)
    for k in (8, 0, 7, 3, 5, 1, 6, 4, 2):  # a chain: only neighbours link, and ids do not follow it
        rows.append((i, [float(v) for v in x * np.cos(0.18 * k) + away * np.sin(0.18 * k)], 5))
        i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 64, 1), (i + 2, [float("nan")] * 64, 1), (i + 3, [1.0, None], 1), (i + 4, rows[0][1], None), (i + 5, [2.0, 0.0], 1), (i + 6, [3.0, 0.0], 1), (i + 7, [float("inf"), 1.0], 1), (i + 8, [], 2)]
    got = {r.vec_id: r for r in caps.op7(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vec", F.lit(0))).collect()}
    for k, (n, component) in brute_links(rows).items():
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n, component, k == component)


def test_vectors_repeated_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(None, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.n_links) for r in caps.op7(same).where("vec_id = 1").collect()] == [(1, 2)] * 3
    assert caps.op7(same.where("false")).count() == 0


@pytest.mark.parametrize(("n", "rows"), [(500, 3000), (5_000, 3000), (1_000_000, 500)])
def test_filters_find_all_near_pairs(n, rows):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    found, each = set(), 0
    for a in range(0, rows, 250):
        lists = [set(zip(*map(np.ndarray.tolist, caps.filters(64, n).lists(v[a : a + 250])), strict=True)) for v in (x, y)]
        found |= {a + r for r, _ in lists[0] & lists[1]}
        each += len(lists[0])
    assert len(found) >= 0.998 * rows and each / rows < 60


def test_filters_hold_few_whatever_the_size():
    rng = np.random.default_rng(4)
    for n in (1_000, 16_000):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.concatenate([caps.filters(64, n).lists(x[a : a + 500])[1] for a in range(0, n, 500)])
        others = (np.bincount(np.unique(codes, return_inverse=True)[1]) ** 2).sum() / len(codes) - 1
        assert others < 6  # rows that a row meets in a filter


# -- 8 and 9: quality and language -----------------------------------------------------------


@pytest.fixture(scope="module")
def more(spark):
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark, more):
    d, labels = (spark.read.parquet(f"{more}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op8(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r.predicted == r.quality) for r in got]) > 0.95
    assert all(r.predicted for r in got if r.toxic and r.quality)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 0), (99, 1)], "doc_id long, quality int")
    got = quality.op8(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.op8(empty, labels).count() == 0 and quality.op8(odd, labels.where("false")).count() == odd.count()


def test_boosting_steps_equal_exhaustive_search():
    rng = np.random.default_rng(9)
    for _ in range(30):
        g, h = rng.standard_normal(12), rng.random(12) * 12 + 0.1
        gain = lambda lo, hi: (g[lo:hi].sum() ** 2) / (h[lo:hi].sum() + 1)
        options = [(gain(0, k) + gain(k, 12) - gain(0, 12), k) for k in range(1, 12) if min(h[:k].sum(), h[k:].sum()) * 4 >= quality.LEAST]
        best, at = max(options, default=(0.0, 0))
        got, place = quality.best_cut(g, h, 0, 12)
        assert got == pytest.approx(max(best, 0.0)) and (best <= 0 or place == at)
        leaves = quality.tree(g, h)
        cuts = np.flatnonzero(np.diff(leaves)) + 1
        assert len(cuts) <= 3
        for lo, hi in zip([0, *cuts], [*cuts, 12], strict=True):
            assert leaves[lo] == pytest.approx(g[lo:hi].sum() / (h[lo:hi].sum() + 1))
        gg, hh = rng.standard_normal((4, 5)), rng.random((4, 5))
        score = lambda a, b: sum(x.sum() ** 2 / (y.sum() + 1) for x, y in ((gg[:a, :b], hh[:a, :b]), (gg[:a, b:], hh[:a, b:]), (gg[a:, :b], hh[a:, :b]), (gg[a:, b:], hh[a:, b:])))
        assert quality.quadrants(gg, hh)[0] == pytest.approx(max(score(a, b) for a in range(1, 4) for b in range(1, 5)))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(10)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    m = quality.boost(x, y)
    for row, score in zip(x[:50], m.score(x[:50]), strict=True):
        total = m.base + sum(t[sum(e <= v for e in edge)] for edge, t, v in zip(m.edges, m.tables, row, strict=True))
        total += sum(t[sum(e <= row[i] for e in a), sum(e <= row[j] for e in b)] for i, j, a, b, t in m.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((m.score(x) >= 0.5) == y).mean() > 0.9  # only a pair can tell


def test_cosines_and_centroids_equal_plain_dictionaries(docs, monkeypatch):
    monkeypatch.setattr(langid, "ROUNDS", 3)
    rows = docs.where("lang is not null").select("doc_id", "text", "lang").limit(60).collect()
    spark = docs.sparkSession
    model = langid.fit(spark.createDataFrame(rows), sample=10**6, clusters=1)
    count = lambda t: Counter(langid.trigrams(t.encode()).tolist())
    df = Counter(d for r in rows for d in count(r.text))
    idf = lambda d: np.log((1 + len(rows)) / (1 + df[d])) + 1

    def unit(v):
        norm = sum(x * x for x in v.values()) ** 0.5
        return {d: x / norm for d, x in v.items()}

    vec = {r.doc_id: unit({d: np.log1p(n) * idf(d) for d, n in count(r.text).items()}) for r in rows}
    centre = {}
    for lang in {r.lang for r in rows}:
        total = Counter()
        for r in rows:
            if r.lang == lang:
                for d, x in vec[r.doc_id].items():
                    total[d] += x
        centre[lang] = unit(total)
    for r in langid.predict(spark.createDataFrame(rows), model).collect():
        cosine = {lang: sum(x * c.get(d, 0) for d, x in vec[r.doc_id].items()) for lang, c in centre.items()}
        best = max(sorted(cosine), key=cosine.__getitem__)
        assert (r.lang_pred, r.score) == (best, pytest.approx(cosine[best], abs=1e-4))


def test_language_on_held_out_texts(spark, more):
    d = spark.read.parquet(f"{more}/documents.parquet")
    got = langid.op9(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_of_odd_rows(odd, empty):
    got = langid.op9(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 8)} == {"und"}
    assert langid.op9(empty).count() == 0
    assert {r.lang_pred for r in langid.op9(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_foreign_text_is_rejected(spark, more):
    d = spark.read.parquet(f"{more}/documents.parquet")
    model = langid.fit(d)
    odd_one = spark.createDataFrame([(1, "Это предложение написано на русском языке и не похоже на остальные."), (2, "日本語の文章です。")], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(odd_one, model).collect())
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(0x430, 0x450, rng.integers(2, 12)))) for _ in range(3000)]
    long = [(n, " ".join(words[int(k)] for k in np.minimum(rng.zipf(1.3, n) - 1, 2999))) for n in (30, 100, 1000, 10_000)]
    assert all(r.rejected for r in langid.predict(spark.createDataFrame(long, "doc_id long, text string"), model).collect())
    assert langid.predict(d, model).where("rejected").count() < 0.005 * d.count()


# -- 10: BPE ---------------------------------------------------------------------------------


def check_bpe(df, tokenizer):
    text = defaultdict(list)
    for r in df.collect():
        text[r.doc_id].append(r.text or "")
    for r in bpe.encode_decode(df, TOKENIZER).collect():
        want = set()
        for t in text[r.doc_id]:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want.add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want


def test_bpe_equals_the_library(docs, odd, empty, tokenizer):
    check_bpe(docs, tokenizer)
    check_bpe(odd, tokenizer)
    assert bpe.encode_decode(empty, TOKENIZER).count() == 0
    full = bpe.encode_decode(odd.where("doc_id = 4"), TOKENIZER, digests=False).first()
    assert tokenizer.decode(full.ids, skip_special_tokens=False) == full.decoded


def test_bpe_keeps_words_over_generations_and_a_new_trie(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "NODES", 100)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    enc, rng = bpe.TrieBPE(TOKENIZER), np.random.default_rng(6)
    texts = [" ".join(f"w{k}ord's \x01\x7f{k}é" for k in rng.integers(0, 60, 30)) for _ in range(40)]
    got = [r for t in texts for r in enc.encode_batch([t])]
    assert [list(map(int, ids.split())) for _, ids, _ in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizer_shapes_are_refused():
    with pytest.raises(ValueError):
        bpe.TrieBPE(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_of_random_strings(tokenizer):
    from random import Random

    rng, enc = Random(5), bpe.TrieBPE(TOKENIZER)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü'1") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    assert [enc.encode(w) for w in words] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


# -- SQL -------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, small, name):
    from oracle import connect, difference

    assert difference(QUERIES[name](spark, small), connect(small), ORACLES[name]) == ""


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, more):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "tokens"]
    docs = spark.read.parquet(f"{more}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, more)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{more}/labels.parquet").where("quality = 0").collect()}
    assert 600 < len(ids) < 950 and len(ids & bad) <= 2
    groups = {r.doc_id: r.component_id for r in minhash.components(docs.join(kept.select("doc_id"), "doc_id", "left_semi")).collect()}
    assert len(set(groups.values())) == len(groups)
    assert set(QUERIES) == {q for q in QUERIES if q.startswith("op")} and len(QUERIES) == 10


def test_near_duplicates_from_eight_tenths_on(spark, small):
    import corpus_pipeline

    rng, rows, sets = np.random.default_rng(8), [], {}
    for k in range(120):  # pairs whose similarity goes from 0.73 to 0.88
        words = [f"v{x}" for x in rng.integers(0, 1 << 40, 300)]
        rows.append((k, " ".join(words)))
        for x in range(4 + k % 6):
            words[10 + x * 11] = f"y{k}-{x}"
        rows.append((1000 + k, " ".join(words)))
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[x : x + 5]) for x in range(len(w) - 4)}
    same = {k: len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) for k in range(120)}
    assert sum(0.8 <= s < 0.85 for s in same.values()) > 20 and sum(s < 0.8 for s in same.values()) > 20
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, small).collect()}
    assert got == set(range(120)) | {1000 + k for k, s in same.items() if s < 0.8}


def test_near_duplicates_keep_one_row_of_each_group_whatever_its_ids(spark, small):
    import corpus_pipeline

    a, b, c, d = ([f"{x}{k}" for k in range(200)] for x in "abcd")
    near = lambda w: [*w[:199], "end"]
    rows = [(2, a), (5, a), (5, b), (9, b), (11, c), (11, near(c)), (None, d), (None, d), (None, near(d)), (None, near(a)), (None, ["alone"]), (12, [])]
    table = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    got = corpus_pipeline.near_duplicates(spark, table, small).collect()
    assert Counter((r.doc_id, (r.text or "-")[:1]) for r in got) == Counter([(2, "a"), (5, "b"), (11, "c"), (None, "d"), (None, "a"), (12, "-")])
    assert ["alone"] == [r.text for r in got if r.doc_id is None and r.text[0] == "a"]


def test_stages_take_odd_rows(odd, small, spark):
    import corpus_pipeline

    names = ("lang_pred", "rejected", "predicted", "row", "hash", "group", "first", "doc", "a`b c")
    wide = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names) if n not in odd.columns])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, small)
        assert name == "tokens" or got.columns == wide.columns
        assert len(got.collect()) > 0 and stage(spark, wide.where("false"), small).count() == 0


def test_columns_to_keep_must_not_clash(odd):
    with pytest.raises(ValueError):
        quality.predict(odd, quality.boost(np.zeros((0, 16)), np.zeros(0)), keep=("doc_id", "score"))


def test_tiles_of_a_large_bucket_grow_as_it_does(spark):
    from candlewick.llm import minhash

    made = {}
    for size in (2_000, 20_000):
        members = spark.range(size).selectExpr("1L bucket", "id rep").unionByName(spark.range(50, 60).selectExpr("2L bucket", "id rep"))
        roots = spark.range(size).where("id % 1000 <> 1").selectExpr("id a", "-1L b")  # one large component and a few ids alone
        split = minhash.opened(members, roots)
        assert split.where("bucket = 2").count() == 0
        rows = minhash.dealt(split).select("bucket", "lo", "hi", "rep", "comp").collect()
        made[size] = len(rows)
        if size == 2_000:
            met = {}
            for r in rows:
                met.setdefault((r.lo, r.hi), []).append(r)
            pairs = {frozenset((x.rep, y.rep)) for tile in met.values() for x in tile for y in tile if x.comp != y.comp}
            assert pairs == {frozenset((x, y)) for x in (1, 1001) for y in range(size) if x != y}
    assert made[20_000] <= 10.5 * made[2_000]


@pytest.mark.parametrize("cells", [64, 1 << 23])
def test_texts_of_a_few_ids(spark, monkeypatch, cells):
    from candlewick.llm import minhash

    monkeypatch.setattr(minhash, "CELLS", cells, raising=False)
    docs = spark.range(500).selectExpr("if(id % 9 = 0, null, id - 250) doc_id", "concat('t', id) text")
    docs = docs.unionByName(docs.where("doc_id < -200"))
    ids = spark.range(-260, 0, 3).unionAll(spark.range(-30, 0, 3)).select("id")
    want = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id < 0 and ((r.doc_id + 260) % 3 == 0 or r.doc_id >= -30 and r.doc_id % 3 == 0))
    got = minhash.texts_of(docs, ids)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("getbit") > plan.index("doc_id#", plan.index("Join Inner"))  # the bitmap lies below the exact join
