"""Token counts without token ids.

Pieces are counted once per distinct pre-token of a block of documents; the
counts are joined to the documents' pre-token frequencies and summed, so no
id sequence is ever materialised. The join stays inside the block: a corpus-
wide vocabulary join would shuffle one row per document and distinct pre-token
(more bytes than the text itself), the block-wise one shuffles nothing. A
worker keeps a bounded cache of counted pre-tokens between blocks.

Null texts count as empty (0 tokens); empty tables give empty results; rows
repeat as they come in; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textloom.llm import bpe_kernel
from textloom.llm.common import id_and_text, map_text_blocks

#: Documents of more tokens than this are over the limit.
CONTEXT_LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = CONTEXT_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the byte-level BPE JSON file `vocabulary`."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text")
        n = bpe_kernel.json_encoder(vocabulary).count(texts.to_pylist())
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_text_blocks(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
