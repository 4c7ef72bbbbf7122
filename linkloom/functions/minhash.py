"""MinHash signatures of character n-grams and their bands, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
# The factors and offsets of the hash family, for 16 and for 20 hashes.
A16 = [1608637543, 1273642420, 1935803229, 787846415, 996406379, 1201263688, 423734973, 415968277, 670094951, 1914837114, 669991379, 429389015, 249467211, 1972458955, 1572714584, 1433267573]
B16 = [434285667, 613608295, 893664919, 648061058, 88409749, 242285876, 2018247425, 953477463, 1427830251, 1883569565, 911989541, 3344769, 780932287, 2114032571, 787716372, 504579232]
A20 = [*A16, 434285668, 613608296, 893664920, 648061059]
B20 = [88409749, 242285876, 2018247425, 953477463, 1427830251, 1883569565, 911989541, 3344769, 780932287, 2114032571, 787716372, 504579232, 1306710475, 479546681, 106328085, 30349564, 1855189739, 99052376, 1250819632, 106406362]
FAMILIES = {16: (A16, B16), 20: (A20, B20)}


def ngram_hash(x: Column) -> Column:
    return F.crc32(F.encode(x, "utf-8")).bitwiseAND(PRIME)


def signature(ngrams: Column | str, num_hashes: int) -> Column:
    """The least hash of each member of the family; null where there is no n-gram."""
    ngrams = F.col(ngrams) if isinstance(ngrams, str) else ngrams
    family = list(zip(*FAMILIES[num_hashes]))

    def least(hashes: Column, a: int, b: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: (h * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME))

    bound = F.transform(F.array(F.transform(ngrams, ngram_hash)), lambda hs: F.array(*(least(hs, a, b) for a, b in family)))
    return F.when(F.size(ngrams) > 0, F.get(bound, F.lit(0)))


def bands(sig: Column | str, num_hashes: int, num_bands: int) -> Column:
    """One key a band: its number and its slice of the signature."""
    sig = F.col(sig) if isinstance(sig, str) else sig
    rows = num_hashes // num_bands
    return F.array(*(F.concat_ws(":", F.lit(str(k)), F.array_join(F.transform(F.slice(sig, k * rows + 1, rows), lambda x: x.cast("string")), "-")) for k in range(num_bands)))
