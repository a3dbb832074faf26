import random

import numpy as np

from paylint.llm import arrays, queries, tokens

#: White space and other characters that look like it or stand beside it.
SPACES = [*map(chr, (0x00, 0x1C, 0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2026, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x3002, 0x0301))]
CHARACTERS = [*"ab Z9\n\t\r .,'!-<|>", *SPACES, "'s", "'re", "\n\n", "  ", "é", "ß", "×", "÷", "ź", "日", "😀", "²", "<|endoftext|>", "word" * 20]


def _odd_texts(n):
    draw = random.Random(7)
    return ["".join(draw.choices(CHARACTERS, k=draw.randrange(12))) for _ in range(n)]


def _wanted(encoder, texts):
    return [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def _same(encoder, texts):
    n, ids = encoder(texts)
    wanted = _wanted(encoder, texts)
    return n.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])


def test_pieces_of_odd_texts():
    encoder, texts = tokens.Encoder(queries.tokenizer_path()), _odd_texts(6000)
    for i in range(0, len(texts), 500):
        assert _same(encoder, texts[i : i + 500])
        encoder.rest(50)


def test_line_feeds_and_marks_inside_need_no_new_pieces():
    encoder, sent = tokens.Encoder(queries.tokenizer_path()), []
    encoder(["word word.", "\n"])
    encode = encoder._encode
    encoder._encode = lambda texts: sent.extend(texts) or encode(texts)
    assert _same(encoder, ["word.\nword word\nword.word. word"]) and "".join(sent) == ".word"


def test_other_pieces_with_the_same_hash(monkeypatch):
    monkeypatch.setattr(arrays.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64) % np.uint64(3))
    encoder, texts = tokens.Encoder(queries.tokenizer_path()), _odd_texts(300)
    assert all(_same(encoder, texts) for _ in range(2))


def test_long_pieces_are_not_kept():
    encoder = tokens.Encoder(queries.tokenizer_path())
    assert all(_same(encoder, ["x" * 1000, "a " + "日本" * 500, "x" * 1000 + " a"]) for _ in range(2))
    assert set(encoder.number) == {None, " a", "a"}


def test_table_grows():
    encoder = tokens.Encoder(queries.tokenizer_path())
    assert _same(encoder, [" ".join(f"{'abcdefghij'[i % 10]}{i}x" for i in range(40_000))]) and len(encoder.table) >= 2 * len(encoder.size)


def test_long_texts_go_by_stretches(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    text = "".join(_odd_texts(1000))
    for end_id in (0, None):
        encoder, lengths = tokens.Encoder(queries.tokenizer_path(), end_id), []
        differ = encoder._differ
        encoder._differ = lambda data, *rest: lengths.append(len(data)) or differ(data, *rest)
        n, ids = encoder([text])
        wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        assert n.tolist() == [len(wanted)] and ids.tolist() == wanted and max(lengths) < 400
