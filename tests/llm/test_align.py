import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grantrisk.llm import align
from grantrisk.llm.queries import op12_alignment

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
CHARS = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or c >= 174]
BYTE = {chr(c): c for c in CHARS} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in CHARS)}
ODD = [None, "", " ", "  a  b ", "a▁b", "<|endoftext|> <s> <0x41>", "a\n\n b\t c", "naïve ☃ 漢字 \U0001f600 zero​width", "　wide  space  x",
       "x" * 300 + " y", " " * 400, "it's 12,5 % of #1 ’s", "\x00 \x00a"]


def whole(text):
    """(A ids, B ids, groups) of one text by the definition."""
    if not text:
        return [], [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    ba = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    bb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return [], [], []
    ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
    groups, i, j = [], 0, 0
    for end in sorted(set(ea.tolist()) & set(eb.tolist())):
        k, m = np.searchsorted(ea, end, "right"), np.searchsorted(eb, end, "right")
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def brute(texts):
    found = [whole(t) for t in texts]
    linked = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in found]
    counts = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (a, b, groups), pairs in zip(found, linked):
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in pairs.items()), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return out


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


@pytest.fixture(scope="module")
def kernel():
    return align.aligner(align.byte_level(open(align.BYTE_LEVEL, "rb").read()), align.piece_level(open(align.PIECES, "rb").read()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab1'st ré\n\t.,-_  \x1c 　 ▁​漢☃\U0001f600\x85\x7f")), max_size=40), max_size=6))
def test_batches_align_like_whole_texts(kernel, texts):
    found = kernel(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        a, b, groups = whole(text)
        (sa, ea), (sb, eb) = ((s[i], s[i + 1]) for s in found.starts)
        assert (found.ids[0][sa:ea].tolist(), found.ids[1][sb:eb].tolist()) == (a, b)
        base = found.group[0][sa] if ea > sa else 0
        assert (found.group[0][sa:ea] - base).tolist() == [k for k, (x, _) in enumerate(groups) for _ in x]
        assert (found.group[1][sb:eb] - base).tolist() == [k for k, (_, y) in enumerate(groups) for _ in y]
        assert found.n_groups[i] == len(groups)


@pytest.mark.parametrize("head", [0, 5, 1 << 19])
def test_figures_of_odd_texts_repeats_and_clashing_columns(spark, monkeypatch, head):
    monkeypatch.setattr(align, "BIG_GROUP", 3)  # groups of more links take the counted way
    monkeypatch.setattr(align, "BLOCK_LINKS", 7)
    texts = ODD + ["the quick brown fox, unbelievably antidisestablishmentarian"] * 2 + ["the fox " * 50]
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, `row` string, at string, pair_a string, n string")
    found = align.staged(align.linked(df, keep_text=False), "t")
    out = align.valued(found, align.staged(align.pair_counts(found), "t"), head_pairs=head)
    assert out.columns == ["doc_id", "row", "at", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert rows_of(out.orderBy("doc_id")) == brute(texts)


def test_tokens_and_groups_are_handed_out(odd_docs):
    out = align.align(odd_docs)
    assert out.columns == [*odd_docs.columns, "a_ids", "b_ids", "a_groups", "b_groups"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        a, b, groups = whole(r.text)
        assert (r.a_ids, r.b_ids) == (a, b)
        assert r.a_groups == [k for k, (x, _) in enumerate(groups) for _ in x]
        assert r.b_groups == [k for k, (_, y) in enumerate(groups) for _ in y]


def test_runs_without_a_cut(spark):
    texts = [" " * 300_000, "z" * 300_000, "\n" * 200_000 + "b", "ab" * 100_000]
    out = align.alignment_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = out.orderBy("doc_id").collect()
    assert all(r.n_a > 0 and r.n_b > 0 and r.n_links >= r.n_groups > 0 for r in rows)


def test_empty_table(no_docs):
    assert align.align(no_docs).count() == 0
    assert align.alignment_figures(no_docs).count() == 0


def test_query_against_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert rows_of(op12_alignment(spark, sf).orderBy("doc_id")) == brute(texts)
