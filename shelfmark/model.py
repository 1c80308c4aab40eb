"""Record shapes and settings shared by the operators."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The block and source kinds a document may carry.
BLOCK_TYPES = (
    "HEADING", "PARAGRAPH", "CODE", "TABLE", "LIST", "QUOTE", "JSON_OBJECT", "JSON_ARRAY", "TITLE",
)
SOURCE_TYPES = ("PDF", "DOCX", "HTML", "MARKDOWN", "JSON", "TEXT", "UNKNOWN")
STRATEGIES = ("fixed", "token", "recursive", "semantic")

CHARS_PER_TOKEN = 4

LOCATION_TYPE = (
    "struct<page:int,dom_path:string,json_path:string,start_offset:int,end_offset:int>"
)
BLOCK_TYPE = (
    "struct<type:string,content:string,section_path:array<string>,"
    f"location:{LOCATION_TYPE},metadata:map<string,string>>"
)
GROUP_TYPE = (
    "struct<text:string,content_type:string,section_path:array<string>,"
    f"location:{LOCATION_TYPE},metadata:map<string,string>,is_protected:boolean,context:string>"
)
DRAFT_TYPE = "struct<content:string,start:int,end:int,token_count:int>"


@dataclass(frozen=True)
class ChunkingConfig:
    """How blocks are gathered before a splitter sees them."""

    max_records_per_chunk: int = 5
    max_tokens: int = 0
    preserve_tables: bool = True
    preserve_code: bool = True
    respect_section_boundaries: bool = True

    def __post_init__(self) -> None:
        if self.max_records_per_chunk <= 0:
            raise ValueError("max_records_per_chunk must be > 0")
        if self.max_tokens < 0:
            raise ValueError("max_tokens must be >= 0")

    def effective_max_chars(self, variant_max_chars: int) -> int:
        if variant_max_chars <= 0:
            raise ValueError("variant_max_chars must be > 0")
        if self.max_tokens > 0:
            return min(variant_max_chars, self.max_tokens * CHARS_PER_TOKEN)
        return variant_max_chars


@dataclass(frozen=True)
class Variant:
    """One way to chunk a corpus; validated on construction."""

    variant_id: str
    strategy: str
    size: int
    overlap: int = 0
    module: str = "basic"
    embedding_model: str = "hashing"
    embedding_dimension: int = 64
    percentile: float = 95.0

    def __post_init__(self) -> None:
        if not re.fullmatch(r"\w{1,60}", self.variant_id or "", re.ASCII):
            raise ValueError(f"invalid variant id: {self.variant_id!r}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown chunking strategy: {self.strategy!r}")
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("a window needs size > 0 and 0 <= overlap < size")
        if self.strategy == "token" and self.max_tokens <= self.token_overlap:
            raise ValueError("token variants need size / 4 > overlap / 4")
        if not 0 < self.percentile <= 100:
            raise ValueError("percentile must be in (0, 100]")

    @property
    def max_tokens(self) -> int:
        return self.size // CHARS_PER_TOKEN

    @property
    def token_overlap(self) -> int:
        return self.overlap // CHARS_PER_TOKEN
