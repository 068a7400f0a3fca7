import hashlib
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from kpiscope.llm import cross_align as c
from kpiscope.llm.bpe_segment import byte_alphabet
from kpiscope.llm.queries import op12_cross_align
from tokenizers import Tokenizer

from .conftest import DOCS, TEXTS

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    " two  spaces  ", "\n\nlines\n \n end\n", "tab\tand\x0bvt\x0cff\r\ncrlf\r x", "nbsp    x  y", "a▁b", "<s>hi</s> <unk> <0x0A>", "᠎ x᠎  y", "\x1c \x1d a \x85b",
    "ﬁ ½ é é", "x\u0000y", "don't  we'll I 'm", " ", "\t", "  ", "中文 字符  😀 😀", "...\n...\n", "); }\r\n  ;\r", "　全角　 x",
]


def brute(texts):
    """Whole texts through both libraries, links by comparing byte ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet, names = byte_alphabet(), {i: w for w, i in a.get_vocab().items()}
    rows, held = [], defaultdict(set)
    for n, t in enumerate(texts):
        whole = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        wa = [bytes(alphabet[x] for x in names[i]) for i in ia]
        wb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not t or b"".join(wa) != whole or b"".join(wb) != whole:
            rows.append(None)
            continue
        ea, eb = [0], [0]
        for w in wa:
            ea.append(ea[-1] + len(w))
        for w in wb:
            eb.append(eb[-1] + len(w))
        links, j0 = [], 0
        for i in range(len(ia)):
            while eb[j0 + 1] <= ea[i]:
                j0 += 1
            j = j0
            while j < len(ib) and eb[j] < ea[i + 1]:
                links.append((ia[i], ib[j]))
                j += 1
        groups, i0, j0 = [], 0, 0
        for e in sorted(set(ea[1:]) & set(eb[1:])):
            i, j = ea.index(e), eb.index(e)
            groups.append(",".join(map(str, ia[i0:i])) + "|" + ",".join(map(str, ib[j0:j])))
            i0, j0 = i, j
        for x in set(links):
            held[x].add(n)
        rows.append((ia, ib, links, groups))
    count, best = {k: len(v) for k, v in held.items()}, defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ia, ib, links, groups = r
            out.append((len(ia), len(ib), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, count


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    words = ["the", "quick", "d'or", "été", "中文", "x" * 40, "...", "12345", "don't", "😀", "a\tb", "\r\n", "é;\r", "--", "A" * 300]
    gaps = [" ", "  ", "\n", " \n ", "\t", "\r", "  ", "  ", "\x0b"]
    made = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return TEXTS + ODD + made


def test_query_against_brute_force(spark, texts, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_cross_align(spark, str(tmp_path)).collect()}
    want, _ = brute(texts)
    for i, w in enumerate(want):
        assert tuple(got[i][k] for k in COLUMNS) == w, repr(texts[i][:80] if texts[i] else texts[i])


def test_blocks_do_not_matter_and_pairs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = c.align(spark.createDataFrame(rows, DOCS).repartition(3), A, B, block_bytes=300, groups=True)
    want, count = brute(texts)
    assert {(r["a"], r["b"]): r["docs"] for r in got.pairs.collect()} == count
    docs = {r["doc_id"]: r for r in got.documents.collect()}
    assert {i: tuple(r[k] for k in COLUMNS) for i, r in docs.items()} == dict(enumerate(want))
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in docs.values() if r["n_a"])


def test_cuts_are_verified():
    spaces = c.safe_spaces(A, B)
    assert spaces == " \t\n\x0b\x0c"
    cut = c.cutter(spaces)
    assert [c.whole(k) for k in c.keys_of("a  b\nc\r d ", cut)] == [" a", "  b", "\nc\r d", " "]
    for t in [*filter(None, ODD), "a b\nc d", "\na", "a\n", " a", "a b "]:
        keys = c.keys_of(t, cut)
        assert "".join(map(c.whole, keys)) == " " + t and list(map(c.whole, keys)) == cut.split(" " + t)
    assert c.safe_spaces(P.path("word_bpe_49k.json"), B) == ""  # no byte-level file: texts stay whole


def test_paths_of_token_sizes():
    assert list(c.path([2, 3], [1, 4])) == [2, 1, 3]
    assert list(c.path([1, 1, 2], [2, 2])) == [1, 3, 3]
    assert list(c.path([5], [1, 2, 2])) == [2, 2, 3] and list(c.path([1, 4], [5])) == [1, 3] and list(c.path([1], [1])) == [3]


def test_packing_gives_back():
    for texts in ([], [""], ["a", "", "é😀", "x" * 300]):
        assert c._unpack(c._pack(texts)) == texts


def test_odd_tables(spark, empty):
    assert c.align(empty, A, B).documents.count() == 0
    df = spark.createDataFrame([("x", "a b", 1), ("x", "a b", 2), (None, None, 3), (None, "a▁", 4)], "doc_id string, text string, `a.b` int").selectExpr("*", "1 as block", "2 as ids")
    got = sorted((r["doc_id"] or "", r["n_a"], r["count_sum"]) for r in c.align(df, A, B).documents.collect())
    assert got == [("", 0, 0), ("", 0, 0), ("x", 2, 4), ("x", 2, 4)]
