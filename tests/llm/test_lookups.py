"""What the word caches of the packing operator and of the token files are asked for."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from statewave.llm import packing, repair


class Counting(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_one_lookup_for_a_known_word():
    encoder = packing.CachedEncoder(packing.default_tokenizer())
    text = "the cat sat on the mat, and the cat slept. 12.5 naïve Straße ok!"
    first = encoder.encode([text])[0].tolist()
    encoder.place = Counting(encoder.place)
    assert encoder.encode([text, ""])[0].tolist() == first
    assert encoder.place.asked == len(text.split())


def test_words_beyond_the_cache(monkeypatch):
    """A full cache starts anew, in the middle of texts that repeat its words."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    encoder, tokenizer = (packing.CachedEncoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer()))
    texts = [" ".join(f"{'abcdefgh'[i % 8] * (i % 5 + 1)}{'xyz'[i % 3]}{'.' * (i % 2)} w{i}" for i in range(n, n + 30)) for n in range(0, 90, 15)]
    for pair in zip(texts, texts[1:]):
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in pair]
        assert [ids.tolist() for ids in encoder.encode(list(pair))] == want


def test_token_files_look_up_a_known_word_once():
    """Letters with marks after them are taken from the ids of both, any other word as the tokenizer has it."""
    encoder, tokenizer = (repair.Encoder(repair.default_tokenizer()), Tokenizer.from_file(repair.default_tokenizer()))
    texts = ["naïve*** naïve &&& ok&&& ok!! Ö. it's don't' abc'*** x$$$y <|endoftext|> a<|endoftext|> 12.5% É** क़*** é###",
             "", "ÉÉ.*** ***", "ok&&& Straße#*# straße a's. ΣΣ### İ## ﬁ$$ ok#'s"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, repair.END_ID] for t in texts]
    asked = []
    encoder.encoded = lambda words, _encoded=encoder.encoded: asked.extend(words) or _encoded(words)
    for _ in range(2):
        encoder.place = Counting(encoder.place)
        (_, _, ids, counts), = encoder.encode(pa.array(texts))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert 0 < encoder.place.asked <= len(set(" ".join(texts).split())) + 2  # the tokenizer's cuts make two parts more
    assert "ok&&&" not in asked and "naïve***" not in asked
