"""The encoder against the library over every code point, and in batches of several texts."""

import struct

from annulus.llm.bpe import WordBpe
from annulus.llm.queries import word_vocabulary


def test_every_code_point_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(word_vocabulary()), WordBpe(open(word_vocabulary(), "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(points[i : i + 256]) for i in range(0, len(points), 256)]
    # side by side, where marks are ordered and composed, up to the private planes
    texts += ["".join(points[i : i + 7]) for i in range(0, 0x20000, 7)]
    for lo in range(0, len(texts), 1000):
        some = texts[lo : lo + 1000]
        for text, ids, want in zip(some, own.ids(some), library.encode_batch(some, add_special_tokens=False)):
            assert ids == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text)


def test_words_at_once_equal_one_at_a_time():
    own = WordBpe(open(word_vocabulary(), "rb").read())
    words = ["a", "the", "internationalisation", "élève", "zzzzzzzz", "x" * 47, "y" * 300, ".", "日本語", "the"]
    ids, begin = own.words(words)
    assert [ids[lo:hi].tolist() for lo, hi in zip(begin, begin[1:])] == [own.word(w) for w in words]
    own.cache.most = 3  # a cache that gives way all the time
    texts = [f"the w{k} élève. {k}" for k in range(50)] + [None, "", "a<|endoftext|>b"]
    assert [own.encoded([t])[0] for t in texts] == own.encoded(texts)
