"""Chunks without provenance are the same chunks, without the work for it."""

from folioflow.operators import chunking, structure
from folioflow.sources import documents


def test_chunks_without_provenance(spark, sf_dir):
    m = structure.mark(documents.raw_elements(spark.read.parquet(f"{sf_dir}/documents.parquet"))).cache()
    e, s = structure.elements(m), structure.sections(m)
    names = ["document_id", "sec_seq", "page", "first_pos", "window", "section_path", "display_text", "text_for_embedding"]
    full, bare = chunking.text_chunks(e, s, 40, 10), chunking.text_chunks(e, s, 40, 10, provenance=False)
    assert sorted(bare.columns) == sorted(names) and bare.count() > 0
    assert full.select(names).exceptAll(bare.select(names)).isEmpty() and bare.select(names).exceptAll(full.select(names)).isEmpty()
    m.unpersist()
