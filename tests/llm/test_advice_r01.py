
from __future__ import annotations

import numpy as np

from docspark.llm import license_scan, queries, token_output


def test_op8_pieces_of_special_strings():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", " <|endoftext|>  <|endoftext|> x", "x <|endoftext|>y <|end", ""]
    ids, counts = token_output._Encoder(queries.tokenizer_path())(texts)
    whole = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
    assert whole[0] == [64, 220, 50256, 275]


def test_op8_odd_strings_equal_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    random = np.random.default_rng(8)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "é", "\u00a0", "\u3000", "'s", "12", "!", "<|endoftext|>", "<|", "\0", "🙂", "\r\n"]
    texts = ["".join(random.choice(alphabet, random.integers(0, 12))) for _ in range(4000)]
    ids, counts = token_output._Encoder(queries.tokenizer_path())(texts, np.array([0], "<u4").tobytes())
    whole = [[*x.ids, 0] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def scanned(spark, *texts):
    rows = list(enumerate(texts))
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    return [r for r in sorted(found, key=lambda r: r.doc_id)]


def test_op6_line_has_the_labels_of_its_best_templates(spark):
    rows = scanned(
        spark,
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY 4.0\nLicensed under CC BY-SA 4.0",
        "Licensed under CC BY-NC-SA 4.0",
        "Released under the MIT License. Licensed under the Apache License, Version 2.0. All rights reserved",
    )
    assert [r.labels for r in rows] == [
        "cc-by,cc-by-nc-4.0",
        "cc-by,cc-by-4.0",
        "cc-by,cc-by-sa-4.0",
        "cc-by,cc-by-4.0,cc-by-sa-4.0",
        "cc-by,cc-by-nc-4.0,cc-by-sa-4.0",
        "apache-2.0,mit,reserved",
    ]
    assert [f.label for f in rows[0].found] == ["cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0"]
