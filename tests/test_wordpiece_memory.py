import tracemalloc

import pandas as pd

from quernstone.functions.wordpiece import encoding


def test_words_of_a_batch_are_not_held_together():
    texts = pd.Series([" ".join(f"w{(i * 7 + k) % 900}" for k in range(600)) for i in range(2000)])
    tracemalloc.start()
    out = list(encoding({w: k for k, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "w", *(f"##{d}" for d in range(10))])}, 1 << 30)(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out[0]) == 2000 and len(out[0].ids[0]) > 600
    # eight bytes a number are what is given back; the words alone were some 70 MB
    assert peak < 8 * sum(map(len, out[0].ids)) + 40e6
