"""What workers keep in memory between tasks and operators."""

import re
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext

from tidemark.llm import memory
from tidemark.llm.bpe import codec
from tidemark.llm.queries import WORD_BPE
from tidemark.llm.word_bpe import encoder


def _kept_mb() -> float:
    """MB that a new process, as in a task, has grown by when arrays are freed."""
    TaskContext._taskContext = object()
    own = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    memory.release()
    pa.array(np.arange(10)).cast(pa.int32())  # imports
    before = own()
    np.ones(30_000_000, np.uint8)  # from here on the default allocator keeps arrays of up to this size
    arrays = [np.ones(6_000_000, np.uint8) for _ in range(8)]
    tables = [pa.array(np.arange(1_000_000)).cast(pa.int32()) for _ in range(8)]
    del arrays, tables
    return own() - before


def test_freed_arrays_of_a_task_go_back():
    with ProcessPoolExecutor(1, mp_context=get_context("spawn")) as pool:
        assert pool.submit(_kept_mb).result(timeout=60) < 10


def test_an_encoder_keeps_its_own_cache_and_drops_others():
    memory.release()
    codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode(["what another operator holds"])
    own = encoder(WORD_BPE)
    assert codec.cache_info().currsize == 0
    own.encode(["what this one holds"])
    held = own.cache.count
    assert encoder(WORD_BPE) is own and own.cache.count == held > 0
    memory.release()
    assert encoder(WORD_BPE) is not own
