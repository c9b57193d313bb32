"""Chunk-wise token ids against the tokenizer itself."""

import random

import pyarrow as pa
import pytest

from meterwise.llm.queries import TOKENIZER
from meterwise.llm.tokens import encode

ALPHABET = [*"abcdeABCXYZ019 .,'!?-_()<>=#\n\t", " ", " ", "'s", "'LL", "İ", "̇", "́", "̸", "Σ", "ς", "ß", "ẞ", "é", "K", " ",
            " ", "م", "०", "Ⅷ", "½", "日", "゙", "か", "가", "ᄀ", "ᅡ", "\U0001f600", "\U0001d7d8", "‍", "ǅ", "ﬁ", "<|endoftext|>"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_of_random_unicode_texts_are_the_tokenizers(seed):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(10_000)] + ["Aİ.", "İ!", "xİ..", "Σ.", "á.", ""]
    offsets, ids = encode(pa.array(texts), TOKENIZER)
    wrong = [t for i, t in enumerate(texts) if ids[offsets[i]:offsets[i + 1]].tolist() != tok.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]
