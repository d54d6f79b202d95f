"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import Memo, tokenizer_path, wide_rows

#: Fixed value of the piece vocabulary: the mark that stands before a word.
WORD_MARK = "▁"


class LongestMatch:
    """Counts the pieces of a greedy longest-match segmentation in one pass over the characters.

    A trie holds the vocabulary. When the character at hand has no edge from a node, the node's failure
    link leads to where the rest of the read text stands after the longest pieces are taken off, and
    ``popped`` of the node says how many tokens these were. No piece is ever built. A character that no
    piece begins with counts as its UTF-8 bytes, as in a vocabulary with byte fallback.
    """

    def __init__(self, pieces: Iterable[str]):
        pieces = {x for x in pieces if x}
        edges: list[dict[str, int]] = [{}]
        weight: list[int] = [0]  # tokens of a node's own text if it is a piece
        for piece in sorted(pieces):
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    weight.append(0)
                node = edges[node][c]
            weight[node] = 1
        for c, node in edges[0].items():
            weight[node] = weight[node] or len(c.encode("utf-8", "replace"))
        failure, popped = [0] * len(edges), [0] * len(edges)
        queue = deque([(0, c, node) for c, node in edges[0].items()])
        while queue:
            parent, c, node = queue.popleft()
            if weight[node]:
                failure[node], popped[node] = 0, weight[node]
            else:
                at, count = failure[parent], popped[parent]
                while c not in edges[at] and at:
                    count += popped[at]
                    at = failure[at]
                # at the root a character without an edge is a token of its own bytes
                if c in edges[at]:
                    failure[node], popped[node] = edges[at][c], count
                else:
                    failure[node], popped[node] = 0, count + len(c.encode("utf-8", "replace"))
            queue.extend((node, x, child) for x, child in edges[node].items())
        self.edges, self.failure, self.popped = edges, failure, popped

    def count(self, text: str) -> int:
        edges, failure, popped = self.edges, self.failure, self.popped
        node = total = 0
        for c in text:
            while c not in edges[node]:
                if node == 0:
                    total += len(c.encode("utf-8", "replace"))
                    break
                total += popped[node]
                node = failure[node]
            else:
                node = edges[node][c]
        while node:
            total += popped[node]
            node = failure[node]
        return total


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    memo_entries: int = 300_000,
) -> DataFrame:
    """Words and greedy word-piece tokens of each whole text: (id, n_words, n_tokens, n_chars).

    Words stand between white space; each is segmented with the word mark before it. A null or empty
    text, or one of white space only, has no words and no tokens. Each input row gives one output row, so
    repeated rows and ids repeat. An empty table gives no rows. Other columns are ignored.
    ``memo_entries`` bounds a worker's memory of words already counted; it doesn't change results.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def batches(it) -> Iterator:
        import pyarrow as pa

        automaton = LongestMatch(vocabulary(path))
        memo = Memo(lambda word: automaton.count(WORD_MARK + word), memo_entries)
        for batch in it:
            words, tokens, chars = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = text.split()
                words.append(len(own))
                tokens.append(sum(map(memo.__getitem__, own)))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, chars))],
                names=[id_col, "n_words", "n_tokens", "n_chars"],
            )

    chosen = wide_rows(docs).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return chosen.mapInArrow(batches, f"{id_col} long, n_words long, n_tokens long, n_chars long")
