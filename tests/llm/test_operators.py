"""Each operator against a brute-force version, over texts that are null, empty, repeated, long or tied."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from graphloom.llm import bpe, language, lm_score, mixing, pii, piecewise, quality, queries, secrets, simhash, suffix_dedup

LINE = "This line stands in many documents and is well over fifty bytes long, so it goes. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, fp string"


def rows():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta", "eta", "theta", "#tag", "ΣΑΣ", "it's"]
    texts = [None, "", " \n\t", "one", "one two", "a b c d", "word " * 3000, "x" * 5000, "ab" * 300]
    texts += [" ".join(rng.choice(words, int(n))) for n in rng.integers(40, 200, 30)]
    texts += [LINE + t for t in texts[9:15]] + texts[9:14] + [LINE * 3]
    return [(i * 3, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 4}", None, 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    made = rows()
    return spark.createDataFrame(made + [made[10]], SCHEMA).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: all anchors that several documents have send windows
    first, got = {}, by_id(suffix_dedup.suffix_dedup(docs))
    for d, t, *_ in rows():
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t, *_ in rows():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        assert got[d].kept == kept and got[d].n_removed == sum(gone) and got[d].kept_sha256 == hashlib.sha256(kept).hexdigest(), d
        assert got[d].n_spans == len(re.findall(rb"\x01+", bytes(gone)))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_sort_orders_and_masks():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, (40, 80)).astype(np.uint8)
    text[::3] = text[0]
    text[1::4, :60] = text[1, :60]
    r, p = np.repeat(np.arange(40), 31), np.tile(np.arange(31), 40)
    r, p = suffix_dedup.Suffixes(text).sort(r, p, np.zeros(len(r), np.int64))
    keys = [text[a, b : b + 50].tobytes() for a, b in zip(r, p)]
    assert keys == sorted(keys)
    docs_ = rng.permutation(40).astype(np.int64)
    masks = suffix_dedup.window_masks(text, np.zeros(40, np.uint64), docs_)
    for i in range(40):
        for j in range(31):
            mine = text[i, j : j + 50]
            assert bool(masks[i] >> j & 1) == any(docs_[k] < docs_[i] and (text[k, j : j + 50] == mine).all() for k in range(40))


def test_suffix_blocks_keep_their_anchors():
    texts = [(t or "").encode() for _, t, *_ in rows()]
    ids, lengths = [None if i == 12 else i for i in range(len(texts))], np.array([len(t) for t in texts], np.int64)
    body = b"".join(t + b"\xff" for t in texts)
    block = suffix_dedup.Block(ids, lengths, body)
    again = suffix_dedup.Block(ids, lengths, body, block.places())
    for name in ("h", "at", "first", "last", "row"):
        assert (getattr(block.found, name) == getattr(again.found, name)).all()
    assert (suffix_dedup.row_keys(suffix_dedup.contexts(block.data, block.found, np.arange(len(block.found.at)))) == block.found.h).all()


def test_equal_rows_share_a_class_though_hashes_collide(monkeypatch):
    text = np.random.default_rng(2).integers(0, 2, (200, 9)).astype(np.uint8)
    key = np.zeros(200, np.uint64)
    want = np.unique(text, axis=0, return_inverse=True)[1].reshape(-1)
    for mix in (suffix_dedup._MIX, np.uint64(0)):  # 0: every row has the same hash
        monkeypatch.setattr(suffix_dedup, "_MIX", mix)
        got = suffix_dedup.row_classes(text, key)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) == got.max() + 1


def test_quality_rules(docs, empty):
    got = by_id(quality.quality_rules(docs))
    for d, t, *_ in rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        counts = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == want
        assert got[d].base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (got[d].base_failed and got[d].kept)
    assert quality.judge("Home | News | Sport | About\n" + " ".join(f"w{i}" for i in range(80)) + ".")[6:8] == (True, 1)
    assert not quality.judge(" | ".join(f"w{i}" for i in range(80)))[6]
    assert quality.quality_rules(empty).count() == 0


def test_bpe(docs, empty):
    t, path = Tokenizer.from_file(queries.tokenizer_path()), queries.tokenizer_path()
    encoded = bpe.encode(docs, path)
    got, again = by_id(encoded), by_id(bpe.decode(encoded, path))
    for d, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[d].ids), "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded == t.decode(ids, skip_special_tokens=False) == again[d].decoded
    assert encoded.count() == len(rows()) + 1 and bpe.encode(empty, path).count() == 0


def test_lm_score(docs, empty, monkeypatch):
    """Against plain sums of log-probabilities, with every softmax written out, and over other partitions."""
    monkeypatch.setattr(lm_score, "ROUNDS", 4)
    rows_ = lm_score.score(docs).collect()
    got = {r.doc_id: r for r in rows_}
    assert len(rows_) == len(rows()) + 1 and lm_score.score(empty).count() == 0
    assert got[0].n_tokens == 0 and got[0].per_token is None and got[0].log_likelihood == 0
    assert sorted(map(str, rows_)) == sorted(map(str, lm_score.score(docs.repartition(1)).collect()))
    coded, vocabulary = lm_score.code(docs)
    table = lm_score.window_table(coded, vocabulary)
    params = lm_score.train(table, vocabulary)
    nets = [lm_score.Network(p, vocabulary.sides, vocabulary.targets) for p in params]
    words = {d: "".join(c.lower() for c in t or "").split() for d, t, *_ in rows()}
    n = Counter(w for d, x in [*words.items(), (30, words[30])] for w in x)
    near, target = (dict(zip(n, x)) for x in vocabulary.lookup(list(n)))
    shares = {w: np.log(m / vocabulary.total[target[w]]) for w, m in n.items()}
    want, windows = {w: {} for w in lm_score.MIXES}, Counter()
    for d, x in words.items():
        logs = dict.fromkeys(lm_score.MIXES, 0.0)
        for i, word in enumerate(x):
            each = []
            for ring, (net, step) in enumerate(zip(nets, lm_score.RINGS)):
                side = [near[x[j]] if 0 <= j < len(x) else vocabulary.sides - 1 for j in (i - step, i + step)]
                windows[ring, *side, target[word]] += 2 if d == 30 else 1
                logits = np.tanh(net.left[side[0]].astype(float) + net.right[side[1]]) @ net.outer.astype(float) + net.prior[0]
                each.append(np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum())
                assert each[-1].sum() == pytest.approx(1)
            for w in logs:
                logs[w] += np.log(w * each[0][target[word]] + (1 - w) * each[1][target[word]]) + shares[word]
        for w in logs:
            want[w][d] = logs[w]
    best = max(want, key=lambda w: sum(want[w].values()) + want[w][30])
    for d, x in words.items():
        if x:
            own = Counter(x)
            assert got[d].unseen == pytest.approx(sum(n[w] == own[w] for w in x) / len(x))
            held = sum(np.log(max(n[w] - own[w], 0.5) / n[w]) for w in x) + want[best][d]
            assert got[d].held_out == pytest.approx(held / len(x), rel=1e-4, abs=1e-3) and got[d].per_token == got[d].log_likelihood / len(x)
    assert {d: r.log_likelihood for d, r in got.items()} == pytest.approx(want[best], rel=1e-4, abs=1e-3)
    per_class = Counter()
    for word in n:
        per_class[target[word]] += np.exp(shares[word])
    assert all(x == pytest.approx(1, abs=1e-4) for x in per_class.values())
    held = Counter()
    for r in table.collect():
        for c, t, m in zip(*lm_score._shard(r["keys"], r["n"], vocabulary.targets)):
            held[r.ring, c // vocabulary.sides, c % vocabulary.sides, t] += m
    assert held == windows and sum(held.values()) == len(lm_score.RINGS) * sum(n.values())
    alone = sum(m * np.log(m / sum(n.values())) for m in n.values())
    assert sum(r.log_likelihood for r in rows_) > 0.9 * alone  # better than words by themselves


def test_lm_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    vocabulary = lm_score.Vocabulary({}, 6, 3, 2, rng.integers(1, 9, 8))
    flat = lm_score.Network.start(vocabulary, 0)
    key = np.unique(rng.integers(0, vocabulary.sides**2 * vocabulary.targets, 60))
    context, target, n = key // vocabulary.targets, key % vocabulary.targets, rng.integers(1, 5, len(key))

    def loss(p):
        net = lm_score.Network(p, vocabulary.sides, vocabulary.targets)
        return -(n * np.log(net.weights(net.hidden(context))[0][np.arange(len(n)), target].astype(float))).sum()

    got = lm_score.Network(flat, vocabulary.sides, vocabulary.targets).gradient(context, target, n)
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-2
        assert got[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-2, abs=0.02)


def test_lm_folds_windows_of_pieces(monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 7)
    rng = np.random.default_rng(5)
    counts = np.array([0, 3, 1, 0, 20, 2, 15, 0])
    near, target, want = rng.integers(0, 4, 41), rng.integers(0, 9, 41), [Counter(), Counter()]
    at = 0
    for m in counts:
        for i in range(m):
            for ring, d in enumerate(lm_score.RINGS):
                left, right = (near[at + j] if 0 <= j < m else 4 for j in (i - d, i + d))
                want[ring][(left * 5 + right) * 9 + target[at + i]] += 1
        at += m
    assert [dict(zip(k.tolist(), n.tolist())) for k, n in lm_score.folded(counts, near, target, 5, 9)] == want
    assert [len(k) for k, _ in lm_score.folded(np.zeros(2, np.int64), near[:0], target[:0], 5, 9)] == [0, 0]


def test_lm_counts_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TEXT", 20_000)
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 1_000)
    words = [f"w{i}zz" for i in range(6000) for _ in range(1 + i % 3)] + ["The", "the", "ÉTÉ", "été"] * 9
    np.random.default_rng(2).shuffle(words)
    texts = [None, "", *(" ".join(words[a : a + 50]) for a in range(0, len(words), 50))]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    n, got, tokens = Counter(w.lower() for w in words), {}, 0
    coded, vocabulary = lm_score.code(made)
    for r in coded.collect():
        counts, codes = (lm_score.unpack(r[c], "<u4") for c in ("counts", "codes"))
        classes, many = lm_score.unpack(r.classes, "<u4")[codes], lm_score.unpack(r.n, "<i8")[codes]
        ends = np.cumsum(counts)
        for d, a, b in zip(r.doc_ids, ends - counts, ends):
            own = (texts[d] or "").lower().split()
            assert len(own) == b - a
            got |= zip(own, zip(classes[a:b].tolist(), many[a:b].tolist()))
            tokens += len(own)
    assert tokens == len(words) and {w: m for w, (_, m) in got.items()} == n
    total = Counter()
    for w, (c, m) in got.items():
        total[c] += m
    assert dict(total) == {c: m for c, m in enumerate(vocabulary.total.tolist()) if m}


def test_lm_classes_grow_with_the_corpus():
    sizes = [lm_score.class_counts(n)[0] for n in (0, 10**5, 10**6, 10**8)]
    assert sizes[0] == lm_score.LEAST_OWN and sizes == sorted(sizes) and len(set(sizes)) == 4


def test_secrets(docs, empty):
    import base64
    import gzip

    x = "password=abcdefghijkl123"
    b64 = base64.b64encode(x.encode()).decode()
    nested = "".join(f"%{c:02X}" for c in base64.b64encode(gzip.compress(b64.encode())))
    for part in (b64, nested, "".join(f"\\u{ord(c):04x}" for c in x)):
        text = f"before {part} after"
        base, spans = secrets.scan(text)
        assert [(text[a:b], k) for a, b, k in spans if (a, b, k) not in base] and all(7 <= a and b <= 7 + len(part) for a, b, _ in spans)
    assert secrets.scan("nothing%20here, plain Words and 12345")[1] == []
    assert secrets.scan("Token: 'abcdefghijkl' ſecret=abcdefghijkl")[0] == [(0, 20, "assign")]
    assert by_id(secrets.secret_scan(docs))[0].spans == "" and secrets.secret_scan(empty).count() == 0


def test_secrets_in_all_of_a_compressed_stream(monkeypatch):
    import base64
    import gzip

    x, rng = b"password=abcdefghijkl123", np.random.default_rng(1)

    def kinds(raw):
        text = "before " + base64.b64encode(raw).decode() + " after"
        base, spans = secrets.scan(text)
        return {k for a, b, k in spans if (a, b, k) not in base and 7 <= a and b <= len(text) - 6}

    assert kinds(gzip.compress(b"nothing ") + gzip.compress(x)) == {"assign"}  # a second member
    assert kinds(gzip.compress(b"x ") + gzip.compress(b"y ") + gzip.compress(x) + b"\0" * 8) == {"assign"}
    pad = b"word " * 3_600_000
    for made in (x + b" " + pad, pad + x, pad[:-8] + x + b" " + pad):  # over 16 MB unpacked
        assert kinds(gzip.compress(made)) == {"assign"}
    assert kinds(zlib.compress(pad + base64.b64encode(x) + b" ")) == {"assign"} and kinds(gzip.compress(pad)) == set()
    monkeypatch.setattr(secrets, "MAX_UNPACKED", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for at in (*range(970, 1010), *range(1990, 2005)):
        words = " ".join(rng.choice(["päper", "b", "stone"], 900)).encode()[: at * 2]
        words = words.decode(errors="ignore").encode() + b" "
        assert kinds(gzip.compress(words[:at].decode(errors="ignore").encode() + b" " + x + b" " + words)) == {"assign"}, at
    assert kinds(gzip.compress(x + b" ok" * 2000 + b"\xff")) == {"assign"}  # bytes that are no text hide nothing


def plain_spans(text):
    """A plain worklist over lists of (character, begin, end): every layer scanned, every run decoded by itself."""
    import base64
    import binascii
    import gzip

    def readable(raw):
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return None

    def spread(run, raw, width):  # only ASCII in these tests, so a character is a byte
        return [(chr(c), run[int(i * width)][1], run[-(-int((i + 1) * width * 3) // 3) - 1][2]) for i, c in enumerate(raw)]

    def url(run):
        return spread(run, bytes.fromhex("".join(c for c, *_ in run).replace("%", "")), 3)

    def escape(run):
        return [(chr(int("".join(c for c, *_ in run[i + 2 : i + 6]), 16)), run[i][1], run[i + 5][2]) for i in range(0, len(run), 6)]

    def packed(run, raw):
        return [(c, run[0][1], run[-1][2]) for c in gzip.decompress(raw).decode()]

    def b64(run):
        body = [x for x in run if x[0] not in "=\n"]
        word = "".join(c for c, *_ in body)
        if len(word) % 4 == 1 or not re.search("[A-Z]", word) or not re.search("[a-z]", word):
            return None
        raw = base64.b64decode(word + "=" * (-len(word) % 4))
        if raw[:2] == b"\x1f\x8b":
            return packed(run, raw)
        if (t := readable(raw)) is None or not t.replace("\n", "").isprintable():
            return None
        return [(chr(c), body[i * 4 // 3][1], body[(i * 4 + 6) // 3 - 1][2]) for i, c in enumerate(raw)]

    def hexa(run):
        raw = binascii.unhexlify("".join(c for c, *_ in run))
        t = readable(raw)
        return None if t is None or not t.replace("\n", "").isprintable() else spread(run, raw, 2)

    kinds = [(r"(?:%[0-9A-F]{2})+", url), (r"(?:\\u[0-9a-f]{4})+", escape), (r"[A-Za-z0-9+/]{16,}={0,2}", b64), (r"(?:[0-9a-f]{2}){16,}", hexa), (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}(?:\n[A-Za-z0-9+/]+(?==*\n))+={0,2}", b64)]
    work, seen, found = [[(c, i, i + 1) for i, c in enumerate(text)]], {text}, {}
    while work:
        now = work.pop()
        flat = "".join(c for c, *_ in now)
        for pattern, decode in kinds:
            out, at = [], 0
            for m in re.finditer(pattern, flat):
                new = decode(now[m.start() : m.end()])
                if new is not None:
                    out += now[at : m.start()] + new
                    at = m.end()
            out += now[at:]
            made = "".join(c for c, *_ in out)
            if made not in seen:
                seen.add(made)
                work.append(out)
                for a, b, k in secrets.base_spans(made):
                    if any(text[x[1] : x[2]] != x[0] for x in out[a:b]):
                        found[out[a][1], out[b - 1][2], k] = 1
    return set(found) | set(secrets.base_spans(text))


def test_secrets_against_a_plain_worklist(spark):
    import base64
    import gzip

    rng = np.random.default_rng(8)
    layers = [
        lambda x: base64.b64encode(x.encode()).decode(), lambda x: "".join(f"%{c:02X}" for c in x.encode()), lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
        lambda x: x.encode().hex(), lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(), lambda x: "\n" + base64.encodebytes(x.encode()).decode(),
    ]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            x = " ".join(rng.choice(["password=abcdefghijkl%d", "AKIAABCDEFGHIJKLMNO%d", "deadbeefdeadbeef0%d", "plain words %d"], int(rng.integers(1, 4)))).replace("%d", str(rng.integers(10, 99)))
            for i in rng.integers(0, len(layers), int(rng.integers(0, 3))):
                x = layers[i](x)
            parts.append(x)
        texts.append(" and ".join(parts))
    got = by_id(secrets.secret_scan(spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")))
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert {tuple(x) for x in secrets.scan(t)[1]} == want, t
        assert {x for x in got[i].spans.split(",") if x} == {f"{k}:{a}:{b}" for a, b, k in want}
        base = secrets.base_spans(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[2] == k for x in base) for k in secrets.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert got[None].spans == got[0].spans and any(r.n_decoded > 1 for r in got.values())


def test_secrets_in_bytes_that_are_no_text_and_each_by_itself():
    import base64
    import gzip

    pair = "secret=abcdefghijkl1 and token: zzzzzzzzzzzzzzz"
    raw = b"\x01\x02 " + pair.encode() + b" \xff"
    for run in (base64.b64encode(raw).decode(), raw.hex(), base64.encodebytes(raw * 3).decode().strip()):
        text = f"aa\n{run}\nbb"
        new = [x for x in secrets.scan(text)[1] if x[2] == "assign"]
        assert len(new) == len(set(new)) == 2 * (1 if "\n" not in run else 3)
        assert all(3 <= a < b <= 3 + len(run) and b - a < len(run) for a, b, _ in new)
    run = base64.b64encode(gzip.compress(pair.encode())).decode()
    assert [x for x in secrets.scan(run)[1] if x[2] == "assign"] == [(0, len(run), "assign")] * 2  # each, though in one place
    assert secrets.scan("%70assword%3Dabcdefghijkl%FF")[1] == [(0, 25, "assign")]


def test_secrets_take_time_in_proportion():
    import base64
    import time

    def took(n):
        text = " ".join("".join(f"%{c:02X}" for c in base64.b64encode(f"token=abcdefgh{i:08d}".encode())) for i in range(n))
        begin = time.process_time()
        assert len(secrets.scan(text)[1]) == n
        return time.process_time() - begin

    took(200)
    assert took(4000) < 7 * took(1000)


def test_mixing(docs, empty):
    got = mixing.mix(docs, block_words=8).collect()
    assert len(got) == len(rows()) + 1 and mixing.mix(empty).count() == 0
    text = {r[0]: (r[1], r[3]) for r in rows()}
    assert all(r["size"] == len((text[r.doc_id][0] or "").encode().split()) and 0 <= r.taken <= 3 * r["size"] for r in got)
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = text[r.doc_id][1]
        sizes[s] += r["size"]
        target[s] = r.target
        taken[s] += r.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:  # share by weight; those above three times their size stop there, and the rest is shared again
        left = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    for s in order:
        want = fixed.get(s, weight[s] * level)
        assert target[s] == pytest.approx(want) and abs(taken[s] - want) < 0.05 * total
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), block_words=8).collect()))


def test_language(spark, empty):
    base = {"aa": "the and of that this with from have", "bb": "der die das und nicht mit einer auch", "cc": "le la les et dans pour avec une"}
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(base[k].split(), 40)), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    labelled = spark.createDataFrame(made, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1000 + i, " ".join(rng.choice(base[k].split(), 20)), None) for i, k in enumerate(["aa", "bb", "cc"] * 5)] + [(1, None, None), (2, "12 !", None)], "doc_id long, text string, lang string")
    got = by_id(language.identify(asked, labelled))
    assert all(got[1000 + i].lang_pred == k and 0 <= got[1000 + i].score <= 1 for i, k in enumerate(["aa", "bb", "cc"] * 5))
    assert got[1].lang_pred == got[2].lang_pred == "und"
    assert language.identify(empty, labelled).count() == 0 and by_id(language.identify(asked, empty))[1000].lang_pred == "und"
    held = labelled.select("doc_id", language.is_held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def plain_grams(text):
    out = Counter()
    for word in "".join("".join(c.lower()[:1] for c in x) if x.isalpha() else " " for x in text).split():
        padded = f"_{word}_"
        for n in (1, 2, 3):
            out.update(padded[i : i + n] for i in range(n == 1, len(padded) - n + 1 - (n == 1)))
    return out


def test_language_profiles_by_plain_counts():
    made = [("x", g, i) for i, (g, _) in enumerate(sorted(plain_grams("banana band").items(), key=lambda t: (-t[1], t[0])))]
    profiles = language.Profiles(made)
    assert profiles.predict(["banana band"])[1][0] > 0.9
    counts = plain_grams("ab ab")
    assert counts["_a"] == 2 and counts["a"] == 2 and counts["_ab"] == 2 and "_" not in counts
    for text in ("Äb ΣΑΣ x, 山田ab2 İi \U0001d49c ß", "", "12 !", "a" * 400 + " \U00020000\U0002a6d6"):
        x = language.points([text])[0]
        got = Counter(language.shown(c) for _, code in language.grams(x, language.POINT_BITS) for c in code.tolist())
        assert got == plain_grams(text), text


def test_language_tells_all_letters_apart(spark):
    """Distances against plain ranks, over texts with thousands of letters, most of them in no profile."""
    rng = np.random.default_rng(12)
    letters = {"han": [chr(c) for c in range(0x4E00, 0x4E00 + 5000)], "kor": [chr(c) for c in range(0xAC00, 0xAC00 + 5000)], "lat": list("abcdefghij")}
    draw = lambda k, n: " ".join("".join(rng.choice(letters[k], 4)) for _ in range(n))
    made = [(i, draw(k, 300), k) for i, k in enumerate([*letters] * 20)]
    asked = [(1000 + i, draw(k, 30)) for i, k in enumerate([*letters] * 4)]
    labelled = spark.createDataFrame(made, "doc_id long, text string, lang string")
    profiles = {}
    for k in letters:
        n = sum((plain_grams(t) for _, t, l in made if l == k), Counter())
        profiles[k] = {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[: language.TOP])}
    assert {(k, g, i) for k, p in profiles.items() for g, i in p.items()} == set(language.learn(labelled))
    got = by_id(language.identify(spark.createDataFrame(asked, "doc_id long, text string"), labelled))
    for d, t in asked:
        own = sorted(plain_grams(t).items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: language.TOP]
        apart = {k: sum(abs(p[g] - i) if g in p else language.TOP for i, (g, _) in enumerate(own)) for k, p in profiles.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 - apart[best] / (language.TOP * len(own)))


def test_piecewise(docs, spark, empty):
    unique = docs.dropDuplicates(["doc_id"])
    got, text = by_id(piecewise.piecewise(unique)), {r[0]: r[1] or "" for r in rows()}
    ids = sorted(text, reverse=True)
    for d, after in zip(ids, ids[1:] + ids[:1]):
        half = len(text[d]) // 2
        edited = text[d][: len(text[d]) - half] + text[after][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text[d])
        assert got[d].near_next == piecewise.likeness(piecewise.fingerprint(text[d]), piecewise.fingerprint(text[after]))
        assert got[d].edited_fingerprint == piecewise.fingerprint(edited)
    assert piecewise.piecewise(docs).count() == len(rows()) + 1 and piecewise.piecewise(empty).count() == 0

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 80, 2))
        assert piecewise.edit_distance(a, b) == slow(a, b)


def test_piecewise_splits_ids_that_many_rows_share(spark):
    """Against a sorted list: a third of the rows without an id, a third of one id, copies among them."""
    rng = np.random.default_rng(13)
    made = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, None if i % 50 == 0 else f"text {rng.integers(0, 200)} " * 5) for i in range(900)]
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in piecewise.piecewise(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect())
    line = sorted(((d is None, -(d or 0), -zlib.crc32((t or "").encode()), t or "", d) for d, t in made))
    want = Counter()
    for now, after in zip(line, line[1:] + line[:1]):
        text, half = now[3], len(now[3]) // 2
        want[now[4], len(text), hashlib.sha256((text[: len(text) - half] + after[3][:half]).encode()).hexdigest()] += 1
    assert got == want


def test_piecewise_signatures_cover_the_whole_text():
    for head in [(a + b) * 2000 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]:  # some have a chunk for each turn
        size, long, short = piecewise.fingerprint(head + "the end of it").split(":")
        assert len(short) <= len(long) <= piecewise.MAX_SIGNATURE
        raw = (head + "the end of it").encode()
        ends = [0, *(i + 1 for i in np.flatnonzero(piecewise.triggers(raw) < (1 << 32) // int(size)) if i + 1 < len(raw)), len(raw)]
        width = 1 if len(ends) > piecewise.COMMON else piecewise.COMMON
        assert long == "".join(piecewise.ALPHABET[piecewise.xxh32_intdigest(raw[a:b]) >> 6 * i & 63] for a, b in zip(ends, ends[1:]) for i in range(width))
    made = [piecewise.fingerprint(f"{a}{b} " * 700) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert len(set(made)) == len(made) and sum(piecewise.likeness(x, y) > 0.5 for x in made[::7] for y in made[::7] if x != y) == 0


def test_simhash(docs, empty):
    got = by_id(simhash.simhash_components(docs))
    values = {}
    for d, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(s.encode(), 42) for s in sh]
        values[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[d].fingerprint == f"{values[d]:016x}"
    group = {d: d for d in values}
    for _ in values:
        for a in values:
            for b in values:
                if (values[a] ^ values[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[a]] == group[a] for a in group):
            break
    assert {d: r.component_id for d, r in got.items()} == group
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_large_classes_and_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    texts = ["one two three four"] * 40 + ["five six seven"] * 3 + [None, "", " "] + ["alone with no id"]
    made = [(None if i % 4 == 0 or i == 46 else i, t, f"c{i}") for i, t in enumerate(texts)]
    got = simhash.simhash_components(spark.createDataFrame(made, "doc_id long, text string, extra string"), ("extra",)).collect()
    same = lambda t: " ".join((t or "").split())
    least = {}
    for d, t, _ in made:
        if d is not None:
            least[same(t)] = min(d, least.get(same(t), d))
    assert sorted((r.extra, r.component_id) for r in got if r.extra != "c46") == sorted((e, least.get(same(t))) for d, t, e in made if e != "c46")
    assert len(got) == len(made) and [r.component_id for r in got if r.extra == "c46"] == [None]


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    made = [(5, 0), (None, 0b111), (3, 0b111111), (None, 1 << 40), (9, -1), (8, -2), (9, -1)]
    monkeypatch.setattr(simhash, "document_fingerprints", lambda docs, carry: spark.createDataFrame(made, "doc_id long, fp long"))
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(None).collect()]
    least = {0: 3, 0b111: 3, 0b111111: 3, 1 << 40: 3, -1: 8, -2: 8}
    assert Counter(got) == Counter((d, fp % (1 << 64), least[fp]) for d, fp in made)


def test_bit_slices():
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = sum((np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64) for _ in range(3)), np.zeros(400, np.uint64))
    values = np.unique(np.concatenate([seed, np.repeat(seed, 10) ^ flips]))
    near = np.unpackbits(simhash.near_matrix(values).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert (near.astype(bool) == ((apart <= 3) & (apart > 0))).all()


def test_suffix_dedup_repeated_rows_in_different_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_TEXT", 1)  # each row is a block
    rng = np.random.default_rng(11)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    made = []
    for i in range(20):
        passage = draw(90)
        made += [(2 * i, draw(60) + passage + draw(60)), *[(2 * i + 1, draw(70) + passage + draw(70))] * 3]
    first = {}
    for d, t in made:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    want = Counter()
    for d, t in made:
        gone = {j for i in range(len(t) - 49) if first[t[i : i + 50]] < d for j in range(i, i + 50)}
        want[d, len(gone), "".join(c for i, c in enumerate(t) if i not in gone).encode()] += 1
    assert Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == want


def test_pii(docs, empty):
    key, text = b"k", "Mail Ann.Lee+x@mail.example.com or ann.lee+x@mail.example.com, +1 (988) 555-2485, 4111111111111111, 42.144.35.254, Mr. John Smith, Mrs Anna Smith."
    out, spans = pii.redact(text, key)
    assert [k for _, _, k in spans] == ["email", "email", "phone", "card", "ip", "male", "family", "female", "family"]
    assert not any(text[a:b] in out for a, b, _ in spans)
    assert out.split("@")[0].split()[1].lower() == out.split("@")[1].split()[-1].lower()  # one entity, one surrogate
    cards = [pii.surrogate("card", f"4{i:015d}", key) for i in range(300)]
    assert len(set(cards)) == 300 and all(len(c) == 16 and c[0] == "4" for c in cards)
    assert sorted(pii.permute(i, 700, key, "t") for i in range(700)) == list(range(700))
    assert {pii.surrogate("male", n, key) for n in pii.MALE} == set(pii.MALE)
    assert by_id(pii.replace_pii(docs, key))[0].redacted is None and pii.replace_pii(empty, key).count() == 0


def test_pii_quick_test_holds_what_every_pattern_needs(spark):
    texts = ["ask 10.0.0.1 or 8.8.8.8 now", "at 1.2.3.4", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a@b.cd", "12-34", "(212) 555-0100", "+1 (2) 34 56", "123-45-6789", "Señora Anna Smith", "fe80::1ff:fe23:4567:890a", "::ffff:c0a8:101", "2001:DB8:0:0:8:800:200C:417A", "00:1b:44:11:3A:B7", "aa-bb-cc-dd-ee-ff", "by Maria Lopez now"]
    for i in range(97):  # an IBAN without three digits side by side
        if pii.iban_ok(x := f"MT{i:02d}MALTABCDEFGHJKLMNOPQRSTUVWXYZAB"):
            texts.append(x)
    got = by_id(pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k"))
    for i, t in enumerate(texts):
        out, spans = pii.redact(t, b"k")
        assert got[i].redacted == out and got[i].n_entities == len(spans) and (spans or t == "12-34"), t
    assert len(texts) == 16


def test_pii_names_by_shape_and_letters_of_any_script():
    key = b"k"
    for text, gone in [
        ("Mr. Smith said", ["Smith"]), ("Frau Schmidt kam", ["Schmidt"]), ("Dr. Amir Khan, here", ["Amir", "Khan"]), ("Mr John Kowalski went", ["John", "Kowalski"]),
        ("Mr. Иван Петров пришёл", ["Иван", "Петров"]), ("to müller@example.com or", ["müller@example.com"]), ("Ms O'Neill-Ärzte.", ["O'Neill-Ärzte"]), ("Mr. 山田 said", ["山田"]),
    ]:
        out, spans = pii.redact(text, key)
        assert [text[a:b] for a, b, _ in spans] == gone and not any(x in out for x in gone), (out, spans)
        script = lambda x: [(pii.unicodedata.name(c).split()[0], c.isupper()) if c.isalpha() else c for c in x]
        assert {k for _, _, k in spans} - {"other", "email"} or script(out) == script(text)
    assert not pii.entities("Mr. and Mrs. were, a Miss I know; Dr. who")
    made = {pii.surrogate("other", "Kö" + a + b, key) for a in pii.LOWER for b in pii.LOWER}
    assert len(made) == 676 and not made & set(pii.FEMALE + pii.MALE + pii.FAMILY)


def test_pii_distinct_entities_have_distinct_surrogates(spark):
    """Over a table, against a dictionary: one surrogate for each entity wherever it stands, no two alike."""
    key, rng = b"k", np.random.default_rng(9)
    made = [f"{a}.{b}.{c}.{d}" for a, b, c, d in rng.integers(0, 256, (300, 4))] + [f"127.0.0.{i}" for i in range(100)] + [f"10.0.{i}.1" for i in range(100)]
    made += [f"{i:03d}-12-{j}" for i in (0, 1, 666, 667, 900, 901) for j in range(1000, 1040)] + [f"user{i}@mail{i % 3}.example.com" for i in range(200)]
    made += [f"+1 (212) 555-{i}" for i in range(1000, 1200)] + [f"fe80::1:{i:x}:2" for i in range(256)] + [f"00:1b:44:11:3a:{i:02x}" for i in range(256)]
    made += [f"Mr. {g} {f}" for g in pii.MALE[:20] for f in (*pii.FAMILY[:5], "Qadir", "Öztürk")]
    texts = [" ; ".join(rng.choice(made, 12)) for _ in range(600)] + [" ; ".join(made[i : i + 9]) for i in range(0, len(made), 9)] + [None, ""]
    rows_ = [(i % 500 if i % 7 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    assert pii.collisions(table, key).count() == 0
    to, back, seen = {}, {}, Counter()
    for r in pii.replace_pii(table.withColumn("old", table.text), key, ("old",)).collect():
        seen[r.doc_id, r.old] += 1
        out, shift = r.redacted, 0
        assert (r.old or None) is not None or (out == r.old and r.n_entities == 0)
        for x in filter(None, r.spans.split(",")):
            kind, a, b = x.split(":")[0], *map(int, x.split(":")[1:])
            new = out[a + shift : b + shift]
            assert len(new) == b - a or kind in ("female", "male", "family", "ip"), (r.old[a:b], new)
            new = pii.surrogate(kind, r.old[a:b], key)
            assert out[a + shift :].startswith(new)
            shift += len(new) - (b - a)
            assert to.setdefault((kind, r.old[a:b]), new) == new and back.setdefault((kind, new), r.old[a:b]) == r.old[a:b]
    assert seen == Counter(rows_) and len(to) > 1500 and all(k[1] != v for k, v in to.items())


def test_pii_key_and_long_texts(spark):
    import time

    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(spark.range(1).selectExpr("id doc_id", "'x' text"), b"")
    assert pii.stored_key(spark) == pii.stored_key(spark) and len(pii.stored_key(spark)) == 32

    def took(n):
        text = " ".join(f"user{i}@example.com" for i in range(n))
        begin = time.process_time()
        assert len(pii.entities(text)) == n
        return time.process_time() - begin

    took(100)
    assert took(16000) < 8 * took(4000)


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain Python, over copies, near copies, odd ids, empty and null texts and extra columns."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 80)) + f". Mail a{i}@example.com." for i in range(12)]
    texts += texts[:4] + [texts[5] + " More.", "too short", None, "", " | ".join(words[:90]), "Menu\n" + texts[3], " ".join(rng.choice(words, 3000)) + "."]
    made = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 1, "x") for i, t in enumerate(texts)]
    made += [(2, texts[7] + " Other.", "en", "s1", 0, 1, "x"), (2, texts[2], "en", "s2", 0, 1, "x"), (None, texts[8], "en", "s1", 0, 1, "x"), (None, texts[8], "en", "s1", 0, 1, "x")]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, copies int, row string").write.parquet(str(tmp_path / "documents.parquet"))
    key, docs_, seen = pii.stored_key(spark), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([tuple(r) for r in docs_.collect()])
        assert all(r[4] == len(r[1]) for r in seen[-1])
    clean = [(d, quality.judge(t)[-1], l, s, len(quality.judge(t)[-1])) for d, t, l, s, *_ in made if quality.judge(t)[6]]
    assert Counter(seen[0]) == Counter(clean) and len(clean) < len(made)

    def bits(t):
        w = [x.lower() for x in t.split()]
        h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows_ = [(*r, bits(r[1])) for r in clean if r[0] is not None]
    group = [r[0] for r in rows_]
    for _ in rows_:
        for i, x in enumerate(rows_):
            group[i] = min([group[i]] + [g for y, g in zip(rows_, group) if (x[5] ^ y[5]).bit_count() <= 3])
    want = {r[0]: {y[:5] for y, h in zip(rows_, group) if y[0] == r[0] == h} for r, g in zip(rows_, group) if r[0] == g}
    got = [r for r in seen[1] if r[0] is not None]
    assert {r[0] for r in got} == set(want) and len(got) == len(want) and all(r in want[r[0]] for r in got)
    assert [r for r in seen[1] if r[0] is None] == [r for r in clean if r[0] is None] and len(want) < len(rows_)
    assert Counter(seen[2]) == Counter((d, x := pii.redact(t, key)[0], l, s, len(x)) for d, t, l, s, _ in seen[1]) and seen[2] != seen[1]
    takes = defaultdict(lambda: [0, 0])
    for r in mixing.mix(spark.createDataFrame(seen[2], docs_.schema)).collect():
        takes[r.doc_id][0] += r.taken
        takes[r.doc_id][1] += r["size"]
    assert Counter(seen[3]) == Counter(r for r in seen[2] for _ in range(int(takes[r[0]][0] / takes[r[0]][1] + 0.5)))
    t = Tokenizer.from_file(queries.tokenizer_path())
    out = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == Counter((r[0], tuple(x := t.encode(r[1], add_special_tokens=False).ids), t.decode(x, skip_special_tokens=False)) for r in seen[3])


def test_suffix_dedup_counts_frequent_anchors_in_one_block(spark):
    rng = np.random.default_rng(3)
    big = rng.integers(97, 123, 500_000).astype(np.uint8)
    at = int(suffix_dedup._stretch(big)[1].argmin())
    gram = big[at : at + 20].tobytes().decode()  # of so low a hash that every window with it picks it
    draw = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = ["".join(gram + draw(30) for _ in range(40)) for _ in range(150)]
    texts += [texts[i][200:900] + draw(60) for i in range(10)]
    body = "\xff".join([*texts, ""]).encode("latin-1")
    block = suffix_dedup.Block(list(range(len(texts))), np.array([len(t) for t in texts]), body)
    assert block.sent[2].max() > suffix_dedup.HOT
    first, got = {}, by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)))
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in enumerate(texts):
        gone = {j for i in range(len(t) - 49) if first[t[i : i + 50]] < d for j in range(i, i + 50)}
        assert got[d].n_removed == len(gone) and bytes(got[d].kept).decode() == "".join(c for i, c in enumerate(t) if i not in gone)


def test_rows_without_id_fare_as_others(spark, monkeypatch):
    """Of every operator that judges rows by themselves, and of mixing, which spreads them."""
    monkeypatch.setattr(lm_score, "ROUNDS", 1)
    texts = [t for _, t, *_ in rows()][:20]
    table = spark.createDataFrame([(d, t, "en", "s") for i, t in enumerate(texts) for d in (i, None)], "doc_id long, text string, lang string, source string")
    path = queries.tokenizer_path()
    encoded = bpe.encode(table, path)
    for made in (quality.quality_rules(table), encoded, bpe.decode(encoded, path), lm_score.score(table), language.identify(table, table), secrets.secret_scan(table)):
        got = [tuple(r) for r in made.collect()]
        at = made.columns.index("doc_id")
        known, lost = (Counter(map(str, (r[:at] + r[at + 1 :] for r in got if (r[at] is None) == x))) for x in (False, True))
        assert known == lost and sum(lost.values()) == len(texts)
    got = [r for r in mixing.mix(table, block_words=8).collect() if r.doc_id is None]
    assert Counter(r["size"] for r in got) == Counter(len((t or "").encode().split()) for t in texts) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    none = bpe.decode(spark.createDataFrame([(1, None), (2, b""), (None, b"")], "doc_id long, ids binary"), path).collect()
    assert {r.doc_id: r.decoded for r in none} == {1: None, 2: "", None: ""}
