import public_tokenizers

from folio.llm import pieces, tokens


def test_words_that_come_again_are_kept_when_a_generation_ends(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    coder = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    own = coder.model.tokenize

    class Counting:
        def tokenize(self, text):
            asked.append(text)
            return own(text)

    coder.model = Counting()
    for i in range(40):
        text = f"Kestrel, Élan {chr(97 + i % 26)}{'abcdefgh'[i % 8]}{'xyz'[i % 3]}q " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}v" for j in range(20))
        assert coder.encode(text.encode()) == coder.number(coder.tokenizer.encode(text, add_special_tokens=False).ids)
    assert asked.count("kestrel") == 1


def test_only_lengths_of_pieces_that_end_so_are_tried():
    own = pieces.Pieces(pieces.model_path())
    for p in own.id:
        if len(p) > 3:
            assert set(own.reach[p[-4:]]) == {1} | {n for n in (2, 3) if p[-n:] in own.id} | {len(q) for q in _ending(own, p[-4:])}
    assert own.reach["tion"] == tuple(sorted(own.reach["tion"], reverse=True)) and 1 in own.reach["tion"]


def _ending(own, letters, known={}):  # noqa: B006
    if not known:
        for q in own.id:
            known.setdefault(q[-4:], []).append(q)
    return [q for q in known[letters] if len(q) >= 4]
