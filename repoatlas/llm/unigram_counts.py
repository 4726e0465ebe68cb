"""Token counts of a unigram vocabulary: forward scores shared by prefixes in a trie."""

import math
from functools import lru_cache

from pyspark.sql import DataFrame

from repoatlas.llm.common import arrow_map, utf8

# Nodes of a worker's trie; beyond them it starts anew, so memory stays bounded. The counts
# of finished words outlast it, in two generations of so many words.
NODES = 300_000
WORDS = 300_000
# Words with more characters are segmented on their own, outside the trie.
LONG_WORD = 200
WORD_START = "▁"
# What each byte of a character outside the vocabulary costs more than the rarest piece.
BYTE_PENALTY = 10.0


def piece_scores(path: str) -> dict[str, float]:
    """Log weights of the whole pieces of a sentencepiece file.

    The file orders its pieces by merge and has no unigram probabilities; a piece's weight
    follows from its place r in that order by Zipf's law, -ln(r + 1).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return {piece: -math.log(r + 1) for r, piece in enumerate(whole, 1)}


class PrefixTrie:
    """Best segmentations of all prefixes inserted so far.

    A node holds its children, and of the path to it the best score and the tokens of that
    segmentation (the fewest among equals). Inserting a word computes only nodes that no
    earlier word has made; the end node has the word's count.
    """

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.limit = nodes
        self.terminal: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.clear()

    def clear(self):
        self.root = ({}, 0.0, 0)
        self.size = 0

    def count(self, word: bytes) -> int:
        """Tokens of a word's best segmentation."""
        known = self.terminal.get(word)
        if known is None and (known := self.older.get(word)) is not None:
            self.terminal[word] = known
        if known is not None:
            return known
        if len(self.terminal) > WORDS:
            self.older, self.terminal = self.terminal, {}
        if self.size > self.limit:
            self.clear()
        text = WORD_START + word.decode("utf-8", "surrogatepass")
        if len(text) > LONG_WORD:
            return self._long(text)
        node, path = self.root, [self.root]
        for at, letter in enumerate(text, 1):
            child = node[0].get(letter)
            if child is None:
                child = node[0][letter] = ({}, *self._best(text, at, path))
                self.size += 1
            node = child
            path.append(node)
        self.terminal[word] = node[2]
        return node[2]

    def _long(self, text: str) -> int:
        """The same without the trie: only the states that a piece can reach are held."""
        path = [self.root]
        for at in range(1, len(text) + 1):
            path.append((None, *self._best(text, at, path)))
            if len(path) > 4 * self.longest:
                del path[: -self.longest]
        return path[-1][2]

    def _best(self, text: str, at: int, path: list) -> tuple[float, int]:
        """Over the pieces that end at ``at``: the best score, and the fewest tokens with it.

        ``path`` ends with the state before ``at``.
        """
        size = len(text[at - 1].encode("utf-8", "surrogatepass"))
        before = path[-1]
        best, tokens = before[1] + size * self.byte, before[2] + size
        scores = self.scores
        for start in range(max(0, at - self.longest), at):
            score = scores.get(text[start:at])
            if score is not None:
                before = path[start - at]
                score += before[1]
                if score > best or (score == best and before[2] + 1 < tokens):
                    best, tokens = score, before[2] + 1
        return best, tokens


@lru_cache(maxsize=2)
def worker_trie(path: str) -> PrefixTrie:
    return PrefixTrie(piece_scores(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens of every row.

    Pre-tokens are the words between ASCII white space. Each worker keeps one trie of the
    distinct pre-tokens that it meets, so nothing is shuffled and copies or hot sources
    change nothing. Null and empty texts have no tokens. Null doc_ids and repeated rows are
    counted row by row; other columns are not read.
    """

    def run(batches):
        trie = worker_trie(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                found = utf8(text).split()
                counts = list(map(trie.terminal.get, found))
                if None in counts:
                    counts = [trie.count(w) if c is None else c for w, c in zip(found, counts)]
                words.append(len(found))
                tokens.append(sum(counts))
            yield {"doc_id": batch["doc_id"], "n_pre_tokens": words, "n_tokens": tokens}

    return arrow_map(
        docs.select("doc_id", "text"), run, "doc_id long, n_pre_tokens long, n_tokens long"
    )
