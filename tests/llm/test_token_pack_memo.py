"""op6: a worker's tasks share one encoder, and which texts may be cut is decided as by the pattern of white space."""

import random
import re

import public_tokenizers

from siftstone.llm import token_pack

PATTERN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z|\A\Z")


def test_odd_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab  \n\t\r\x1c\x85\xa0 ​　é\0") if rng.random() < 0.2 else rng.choice("abé \n") for _ in range(rng.randint(0, 6)))
        assert token_pack.is_odd(text) == (PATTERN.search(text) is not None), repr(text)


def test_tasks_share_what_was_learned():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = token_pack.lasting_encoder(path, 1)
    texts = ["Some words here\nand there", "an odd  text", "", "words Some\nhere"]
    want = [first._whole(t).tobytes() for t in texts]
    assert first(texts) == want
    assert token_pack.lasting_encoder(path, 1) is first and first(texts) == want
    assert token_pack.lasting_encoder(path, 2) is not first
