"""Words as 64-bit hashes, and names for columns of one's own."""

import xxhash

# Words whose hashes a task remembers.
REMEMBERED = 300_000


class Hashes(dict):
    """64-bit hashes of words, as signed numbers."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def plain_row_name(columns: list[str]) -> str:
    """A name for a key of the rows that no given column has."""
    own = "_row"
    while own in columns:
        own += "_"
    return own
