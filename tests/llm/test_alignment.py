import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paylint.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a  b ", "a\tb\n\n c\r\n", "one\x1f two\x85 three　 four", "it's <|endoftext|> <s> <0x41> </s>", "a▁b c", "plain text after it", "naïve ﬁ Ａ 😀 日本語 текст", "x" * 3000, "tab\t\ttab \n \n end ", "\x00 nul \x00", "é é​ ﻿"]


def plain(rows):
    """The contract, one link at a time."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in byte.values())}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc, text in rows:
        tokens = [[], []]
        if text:
            tokens = [[(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, bytes_b(i)) for i in b.encode(text, num_threads=1)]]
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in tokens):
                tokens = [[], []]
        spans = []
        for t in tokens:
            at, out = 0, []
            for i, x in t:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({z for _, _, z in spans[0]} & {z for _, _, z in spans[1]})
        groups, links, low = [], [], 0
        k = [0, 0]
        for end in ends:
            part = [[], []]
            for side in (0, 1):
                while k[side] < len(spans[side]) and spans[side][k[side]][2] <= end:
                    part[side].append(spans[side][k[side]])
                    k[side] += 1
            groups.append("|".join(",".join(str(i) for i, _, _ in p) for p in part))
            links += [(x, y) for x, s, e in part[0] for y, u, v in part[1] if s < v and u < e]
        count.update(links)
        docs.append((doc, len(spans[0]), len(spans[1]), groups, links))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(doc, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in docs]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_odd_texts_and_given_documents_equal_a_plain_version(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [*given, *((10_000 + i, t) for i, t in enumerate(ODD)), given[0], (None, given[1][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, pair int").repartition(3)
    assert run(alignment.compared(docs, A, B)) == Counter(plain(rows))


def test_sections_small_caches_and_shuffled_pairs_change_nothing(spark, monkeypatch):
    texts = [" ".join(f"word{i * 7919 % 500}x{k}" + ("\n" if i % 13 == 0 else "") for i in range(400)) for k in range(6)] + ["bad ▁ " + "text of some length " * 200]
    rows = list(enumerate(texts))
    want = Counter(plain(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "CHUNK", 500)
    monkeypatch.setattr(alignment, "CACHE", 300)
    monkeypatch.setattr(alignment, "KEPT", 20)
    for _ in range(2):
        counts, sums, regular, others = aligner(texts)
        assert [(*c[:4], s) for c, s in zip(counts.tolist(), sums, strict=True)] == [(*r[1:5], r[7]) for r in sorted(plain(rows))]
        assert regular[2].sum() + others[2].sum() == counts[:, 3].sum()
        aligner.rest(20)
        assert len(aligner.text) <= 20
    monkeypatch.undo()
    held = alignment.saved(alignment.aligned(docs, A, B), "aligned")
    assert run(alignment.summed(held, alignment.pair_counts(held, A, B), len(alignment.ByteLevel(A).bytes), broadcast=0)) == want


def test_identity_map_takes_pieces_and_no_single_bytes():
    model = alignment.Pieces(B)
    same = alignment.identity_map([b"A", b" the", b"", b"\xff\xfe"], model.bytes, model.byte)
    assert model.model.id_to_piece(int(same[0])) == "A" and model.model.id_to_piece(int(same[1])) == "▁the"
    assert same[2] == same[3] == -1


def test_an_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(alignment.compared(empty, A, B)) == Counter()


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 50_000 + "end", "word " * 40_000])
def test_long_texts(text):
    counts, sums, *_ = alignment.Aligner(A, B)([text])
    want = plain([(0, text)])[0]
    assert (*counts[0].tolist(), sums[0]) == (*want[1:5], want[7])
