from paylint.llm import queries, tokens

TEXTS = ["word word. word, (word) word!? word's. 7. é. ª. x<|endoftext|>. <|endoftext|>.", "日本. a…. 'll. '. .word \tb. wörd.\n\nword. ", "", "..."]


def test_words_with_marks_behind_are_not_encoded_again():
    encoder, sent = tokens.Encoder(queries.tokenizer_path()), []
    encoder(["a word . !?"])
    encode = encoder._encode
    encoder._encode = lambda texts: sent.extend(texts) or encode(texts)
    encoder(["a word. word!?"])
    assert not [t for t in sent if "word" in t]
    for _ in range(2):
        n, ids = encoder(TEXTS)
        wanted = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in TEXTS]
        assert n.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
        encoder.rest(4)


def test_frequent_pieces_stay():
    encoder = tokens.Encoder(queries.tokenizer_path())
    encoder(["some words that come first and once", *["late word"] * 3, "late word."])
    encoder.rest(3)
    assert list(encoder.number.values()) == [0, 1, 2] and {None, "word"} < set(encoder.number)
    assert encoder(["late word."])[1].tolist() == [*encoder.tokenizer.encode("late word.").ids, 0]
