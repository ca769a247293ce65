"""Texts that the tests of several operators share."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}, more" for i in range(90_000))  # about 1.8 MB
ODD = [None, "", "  \n\t ", "a", "a b\x0bc\x0cd", "x y.\n\nx y.\nx y. ", "é, Å. naïve ß “q”.", "İstanbul ΣΑΣ ﬁ nb\u00a0sp \u3000 z\x85y \x1c",
       "日本語。 テスト, привет. ½ ² ×, ÷.", "<|endoftext|> Hi<|ENDOFTEXT|> a<|startoftext|>b", "it's, I'LL don'T 'tis 're,'s. 12.5, 3. a.,., b..",
       "\U0001F600, x.", "#*$%&|<> ### $$$", "x" * 5000 + " " + "ab " * 3000, LONG]
