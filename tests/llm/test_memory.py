"""What tasks leave in the Python processes that all stages of a session share."""
import numpy as np

from plaintide.llm import common, langid, packing


def size(x) -> int:
    return sum(a.nbytes for a in x)


def test_a_process_keeps_what_one_stage_left():
    path = packing.default_tokenizer()
    common.kept(("bpe", path), lambda: packing.ByteBpe(path))
    codes = langid.grams(langid.symbols("the quick brown fox"), langid.ORDER)
    u, n = np.unique(codes, return_counts=True)
    model = langid.LanguageModel(["a", "b"], [langid.KneserNey.fit(u, n)] * 2, np.full(2, np.inf))
    langid._entropies(model, "t", [codes])
    assert list(common._kept) == [("langid", "t")] and size(common._kept["langid", "t"]) <= 1 << 24


def test_the_slower_tokenizer_is_loaded_when_needed():
    bpe = packing.ByteBpe(packing.default_tokenizer())
    texts = ["the quick  brown\tfox", "die Größe ist 12 kg", "", " a"]
    got = [bpe.ids(t) for t in texts]
    assert bpe.fast is None or "whole" not in vars(bpe)
    assert got == [np.array(bpe.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert bpe.ids(f"x{packing.SPECIAL}y") == np.array(bpe.whole.encode(f"x{packing.SPECIAL}y", add_special_tokens=False).ids, "<u4").tobytes()
