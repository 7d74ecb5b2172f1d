"""Token alignment, the n-gram join and periodic runs against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from regraph.llm import jaccard_join, periodic_runs, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], SCHEMA)


# --- alignment -----------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(5)
    letters = "ab é  \n\t '1.,ﬁ漢字🙂▁<|>s_\x85\x1c​"
    out = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(120)]
    out += [" ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "don't  stop 's", "<s> </s> <unk> <0x41>", "<|endoftext|> a<|endoftext|>", "▁a", "word " * 400]
    return out + ["The quick brown fox, 1234567 jumped." * 3, "x" * 5000, "na" * 900 + " end", "  lead", "trail  "]


def align_brute(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = token_alignment.byte_letters()
    docs, count = [], Counter()
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False)
        ids_b = b.encode(t or "")
        parts_a = [bytes(letters[c] for c in x) for x in ids_a.tokens]
        parts_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
        if not t or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            docs.append((i, [], [], [], []))
            continue
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(parts_a), spans(parts_b)
        links = [(ids_a.ids[x], ids_b[y]) for x, (p, q) in enumerate(sa) for y, (u, v) in enumerate(sb) if p < v and u < q]
        cuts = sorted({q for _, q in sa} & {v for _, v in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append((",".join(str(ids_a.ids[x]) for x, (_, q) in enumerate(sa) if low < q <= c), ",".join(str(ids_b[y]) for y, (_, v) in enumerate(sb) if low < v <= c)))
            low = c
        count.update(links)
        docs.append((i, ids_a.ids, ids_b, groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, x, y, groups, links in docs:
        text = ";".join(f"{p}|{q}" for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


def aligned(spark, rows, **options):
    import public_tokenizers as P

    docs = table(spark, rows).withColumnRenamed("n_chars", "pairs").withColumnRenamed("source", "block")
    got = token_alignment.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_alignment(spark, block):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(900, None), (901, ""), (902, "same text"), (902, "same text"), (903, "same text"), (None, "same text here")]
    assert aligned(spark, rows, block_bytes=block) == sorted(align_brute(rows), key=str)


def test_alignment_of_nothing(spark):
    assert aligned(spark, []) == []
    assert aligned(spark, [(1, None), (2, "")]) == sorted(align_brute([(1, None), (2, "")]), key=str)


def test_chunks_of_whole_texts_agree(spark):
    import public_tokenizers as P

    both = token_alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert not both.crossing
    import pyarrow as pa

    texts = pa.array([t for t in odd_texts() if "▁" not in t])
    joined = []
    for whole in (False, True):
        offsets, codes, chunks = token_alignment.chunked(texts, whole)
        found = both.align(chunks)
        joined.append([";".join(found.texts[c] for c in codes[a:b]) if all(found.good[c] for c in codes[a:b]) else None for a, b in zip(offsets, offsets[1:])])
    assert joined[0] == joined[1]


def test_labels():
    assert token_alignment.label_string(np.array([2, 3, 5]), np.array([1, 3, 5])) == bytes([2, 1, 3, 0, 3])
    assert token_alignment.scanned(bytes([2, 1, 3, 0, 3])) == [(2, 2), (1, 1)]


# --- periodic runs -------------------------------------------------------------------------------


def runs_brute(s, periods=4, least=6):
    n, out = len(s), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if s[i] != s[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and s[i] == s[i + p]:
                i += 1
            size = i + p - a
            if size >= max(least, periods * p) and not any(s[a : a + size - q] == s[a + q : a + size] for q in range(1, p)):
                out.append((a, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def report_brute(i, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = runs_brute(w)
    drop = {k for a, size, p in runs for k in range(a + p, a + size)}
    top = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    facts = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *facts, digest("".join(f"{a},{size},{p}\n" for a, size, p in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in drop)))


def repetitive(seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(160):
        w = [r.choice("ab c d e f g h".split()[: r.randrange(1, 8)]) for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(3)):
            p, at = r.randrange(1, 7), r.randrange(len(w) + 1)
            w[at:at] = [f"x{k % p}" for k in range(r.randrange(3, 40))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(500, None), (501, ""), (502, "  "), (None, "a b " * 9), (503, "a " * 30), (503, "a " * 30), (504, "lone " * 3), (505, "a b " * 12)]


def test_runs(spark):
    rows = repetitive()
    docs = table(spark, rows).withColumnRenamed("n_chars", "start").withColumnRenamed("source", "period")
    for plant in (True, False):
        got = [tuple(r)[:8] for r in periodic_runs.periodic_runs(docs, plant=plant).collect()]
        assert sorted(got, key=str) == sorted((report_brute(i, t, plant) for i, t in rows), key=str)
    assert periodic_runs.periodic_runs(table(spark, [])).count() == 0


@pytest.mark.parametrize("periods", [2, 3, 4])
def test_runs_of_small_alphabets(periods):
    r = random.Random(periods)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(40))]
        if r.random() < 0.5 and s:
            p = r.randrange(1, 7)
            s = [s[k % p % len(s)] for k in range(len(s))]
            s[r.randrange(len(s))] = 9
        assert periodic_runs.runs_of(s, periods, 2) == runs_brute(s, periods, 2)
        cut = [(a + x, n, p) for a, b in periodic_runs.stretches(np.array(s, np.int64), np.zeros(len(s), np.int64), periods, 2) for x, n, p in periodic_runs.runs_of(s[a:b], periods, 2)]
        assert sorted(cut, key=lambda x: (x[0], x[2])) == runs_brute(s, periods, 2)


def test_long_texts_take_linear_time(spark):
    """Comparisons, counted by a list that counts its reads, grow with the length alone."""

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            self.reads += 1
            return super().__getitem__(k)

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 40_000:
        fib.append(fib[-1] + fib[-2])
    shapes = [[0] * 40_000, [k % 1000 for k in range(40_000)], sum(([0] * k + [1] for k in range(280)), []), sum(([0] * (280 - k) + [1] for k in range(280)), []), fib[-1], ([0] * 500 + [1]) * 80]
    for s in shapes:
        for word in (s, [-x for x in s]):
            counted = Counted(word)
            periodic_runs.next_smaller(counted)
            assert counted.reads < 12 * len(s)


def test_collapsed_texts(spark):
    rows = [(1, "a b " * 5 + "end"), (2, "one  two\nthree"), (3, None)]
    out = {r.doc_id: r for r in periodic_runs.collapsed(table(spark, rows)).collect()}
    assert out[1].text == "a b end" and out[2].text == "one  two\nthree" and out[3].text is None and out[1].lang == "en"


# --- n-gram join ---------------------------------------------------------------------------------


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def join_brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 80 * len(sets[x] | sets[y]):
                part[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def families(seed, groups=12, members=14, long=160):
    """Families of edited, cut and assembled texts, copies among them, and passages that many texts share."""
    r = random.Random(seed)
    word = lambda: f"W{r.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 30, 80, long]))]
        if r.random() < 0.5:
            base += passage
        for _ in range(members):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.2:
                own = own[r.randrange(len(own) // 5 + 1) :]
            rows.append((len(rows) * 3 + 1, r.choice([" ", "\n\t"]).join(own if r.random() < 0.8 else [x.lower() for x in own])))
    r.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A  b"), (5005, "b a"), (5006, "x " * 30), (5007, "x " * 9), (5007, "x " * 9), (None, "p q r s t u v"), (None, "p q r s t u v")]


@pytest.mark.parametrize("seed,rare,block", [(1, 8, 1 << 23), (2, 0, 1 << 12), (3, 1, 1 << 11)])
def test_jaccard_join(spark, seed, rare, block):
    rows = families(seed)
    docs = table(spark, rows).withColumnRenamed("n_chars", "row").withColumnRenamed("source", "one")
    got = jaccard_join.jaccard_components(docs, rare=rare, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == join_brute(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0
    assert join_brute([(1, None)]) == [tuple(r) for r in jaccard_join.jaccard_components(table(spark, [(1, None)])).collect()]


@pytest.mark.parametrize("rare", [0, 2, 50])
def test_similar_sets_share_a_signature(rare):
    """Sets at exactly the least similarity, whatever tokens they lack, from size 1 to 400."""
    r = np.random.default_rng(rare)
    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 129, 200, 255, 256, 257, 400]:
        for _ in range(12):
            tokens = r.integers(0, 2**63, 2 * n + 2).astype(np.uint64)
            counts = r.integers(2, 60, len(tokens))
            m = min(int(r.integers(n, 100 * n // 80 + 1)), len(tokens))
            both = next(k for k in range(n + 1) if 100 * k >= 80 * (n + m - k)) if 100 * n >= 80 * m else None
            if both is None or n + m - both > len(tokens):
                continue
            x, y = np.r_[0:n], np.r_[n - both : n - both + m]
            shuffled = r.permutation(len(tokens))
            found = []
            for s in (shuffled[x], shuffled[y]):
                s = s[np.lexsort((tokens[s], counts[s]))]
                found.append(set(jaccard_join.signatures_of(len(s), tokens[s], counts[s], rare=rare)[0].tolist()))
            assert found[0] & found[1]
