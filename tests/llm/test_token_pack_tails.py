"""op6: punctuation is cut off words before they are encoded, and a full memo keeps what it learned first."""

import random

import public_tokenizers

from siftstone.llm import token_pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tails_change_no_id():
    rng, encoder = random.Random(5), token_pack.Encoder(PATH)
    ends = ["", ".", ",", "...", "%%%", "'", "'s", "'s,", "-", ")", "!?", "_", "́", "…", "²"]
    texts = [" ".join(rng.choice(["", "(", "'", "-"]) + rng.choice(["word", "Éa", "x9", "don't", "中", "ª", "½", "ɐa", "á", "", "٣"]) + rng.choice(ends) for _ in range(rng.randint(1, 8))).replace(" w", "\nw") for _ in range(3000)]
    texts = [t for t in texts if not token_pack.is_odd(t)]
    assert encoder(texts) == [encoder._whole(t).tobytes() for t in texts] and len(texts) > 1000


def test_a_word_is_encoded_once_for_all_its_tails():
    encoder, learned = token_pack.Encoder(PATH), []
    inner = encoder._learn
    encoder._learn = lambda fresh: learned.extend(fresh) or inner(fresh)
    encoder(["erblewhing erblewhing, erblewhing. x"])
    encoder(["x erblewhing%%%"])
    assert sorted(learned) == sorted(["\0erblewhing", "erblewhing", "x", "\0,", "\0.", "\0x", "\0%%%"])


def test_a_full_memo_keeps_its_first_half(monkeypatch):
    monkeypatch.setattr(token_pack, "_MEMO", 40)
    encoder = token_pack.Encoder(PATH)
    encoder(["often very often"])
    for n in range(100):
        texts = [f"often w{n} x{n}, y{n}."]
        assert encoder(texts) == [encoder._whole(t).tobytes() for t in texts] and len(encoder.memo) <= 40
        if n == 20:
            assert 0 < encoder.times < 8 and "often" in encoder.memo and "w12" not in encoder.memo
    assert encoder.times > 8
