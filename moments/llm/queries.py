"""The queries of the subpackage and their SQL, where SQL can express them."""

from moments.llm import decontam, descriptors, huffman, neardup, quality, resharding, secrets, suffixes, warc, words

QUERIES = {
    "op1_token_files": huffman.op1_token_files,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_reshard": resharding.op3_reshard,
    "op4_image_copies": descriptors.op4_image_copies,
    "op5_warc": warc.op5_warc,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_bpe": words.op7_bpe,
    "op8_neardup": neardup.op8_neardup,
    "op9_secrets": secrets.op9_secrets,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {
    "op5_warc": warc.OP5_SQL,
    "op6_decontaminate": decontam.OP6_SQL,
    "op9_secrets": secrets.OP9_SQL,
}
