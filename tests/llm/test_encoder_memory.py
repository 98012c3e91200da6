"""What a worker holds to encode: words in their small form, one vocabulary however many runs there are."""

import sys

from siembra.llm import sentencepiece_codec as SP

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Shared:
    """A broadcast that counts how often it is read."""

    def __init__(self, vocabulary):
        self.vocabulary, self.reads = vocabulary, 0

    @property
    def value(self):
        self.reads += 1
        return self.vocabulary


def test_known_words_are_small_and_ids_stay():
    from sentencepiece import SentencePieceProcessor

    texts = ["the quick brown fox", "  two  spaces", "the▁mark in a text", "a\n\n b"]
    codec = SP.Codec(SP.Vocabulary.load(MODEL))
    ids, where = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)] == SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert " quick" in codec.known
    assert all(sys.getsizeof(w) < 64 for w in codec.known)


def test_a_held_vocabulary_is_not_read_again(monkeypatch):
    monkeypatch.setattr(SP.Codec, "_held", {})
    first, second = Shared(SP.Vocabulary.load(MODEL)), Shared(None)
    assert SP.Codec.of(1, first) is SP.Codec.of(1, second)
    assert (first.reads, second.reads) == (1, 0)
