"""Hashes of slices: words built to clash modulo 2^64 stay apart; equal words agree anywhere."""

import numpy as np
import pyarrow as pa
import pytest

from farebox.llm.quality_rules import measure
from farebox.llm.text_arrays import Hasher, Words, shingle_sets, slices


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def slice_of(texts):
    return next((data, offsets) for _, data, offsets in slices(pa.array(texts)))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
@pytest.mark.parametrize("lower", [False, True])
def test_thue_morse_words(n, lower):
    data, offsets = slice_of([thue_morse(n, "ab"), thue_morse(n, "ba")])
    one, other = Words(data, offsets, lower).hashes
    assert one != other
    one, other = (set(map(int, s)) for s in shingle_sets(Words(data, offsets, lower), 4))
    assert not one & other


def test_lines_built_to_clash_are_not_repeats():
    data, offsets = slice_of([f"{thue_morse(1024, 'ab')}\n{thue_morse(1024, 'ba')}\n{thue_morse(1024, 'ab')}"])
    assert measure(data, offsets)["n_dup_lines"].tolist() == [1]


def test_equal_slices_agree_wherever_they_stand():
    r = np.random.default_rng(3)
    part = r.integers(0, 256, 500).astype(np.uint8)
    data = np.concatenate([part, r.integers(0, 256, 3000).astype(np.uint8), part])
    h = Hasher(data)
    starts = r.integers(0, 400, 200)
    ends = starts + r.integers(1, 100, 200)
    assert (h(starts, ends) == h(starts + 3500, ends + 3500)).all()
    assert len(set(h(np.arange(3000), np.arange(3000) + 9).tolist())) == 3000
    upper = np.frombuffer(b"Word wORD word", np.uint8)
    assert len(set(Hasher(upper, lower=True)(np.array([0, 5, 10]), np.array([4, 9, 14])).tolist())) == 1
    assert len(set(Hasher(upper)(np.array([0, 5, 10]), np.array([4, 9, 14])).tolist())) == 3


def test_value_modulo_the_prime_by_the_definition():
    from farebox.llm import text_arrays as t

    data = np.frombuffer(b"some bytes, some more bytes", np.uint8)
    sums = t._PrimeSums(data, t._PRIME_BYTES[0], t._PRIME_BASES[0])
    want = sum(int(t._PRIME_BYTES[0][b]) * pow(t._PRIME_BASES[0], i, t._PRIME) for i, b in enumerate(data[5:20]))
    assert int(sums(np.array([5]), np.array([20]))[0]) == want % t._PRIME
