"""A text without a letter has no language, however many numerals it holds."""

import pandas as pd
import public_tokenizers

from palaver.llm import language_id


def test_numerals_are_no_letters():
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = pd.DataFrame({"lang": ["en", "fr"], "word": ["▁the", "▁le"], "n": [9, 9]})
    langs, table = language_id.fit(counts, language_id.Pieces(path))
    texts = ["① ② ③ " * 5, "½ " * 9, "① " * 12 + "the"]
    got = next(language_id.predict(iter([pd.DataFrame({"id": [0, 1, 2], "text": texts})]), path, langs, table))
    assert list(got["lang_pred"][:2]) == ["und", "und"] and got["lang_pred"][2] != "und"
