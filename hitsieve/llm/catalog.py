"""Registered queries of the training-data operators and their SQL twins."""

from hitsieve.llm import (alignment, bpe, classifier, derivatives, linededup, mixing, ngramjoin, piecetable, qualityrules,
                          suffixes, trietokens, variants, vectorjoin)

QUERIES = {f.__name__: f for f in (
    derivatives.op1_warc_derivatives, bpe.op2_bpe_round_trip, mixing.op3_source_mixing, linededup.op4_line_dedup,
    ngramjoin.op5_ngram_jaccard, vectorjoin.op6_embedding_near_dedup, trietokens.op7_token_counts,
    qualityrules.op8_quality_rules, classifier.op9_quality_classifier, suffixes.op10_suffix_dedup,
    variants.op11_spelling_variants, alignment.op12_tokenizer_alignment, piecetable.op13_sentencepiece_round_trip)}
ORACLES = {
    "op3_source_mixing": mixing.OP3_SQL, "op4_line_dedup": linededup.OP4_SQL, "op5_ngram_jaccard": ngramjoin.OP5_SQL,
    "op6_embedding_near_dedup": vectorjoin.OP6_SQL, "op8_quality_rules": qualityrules.OP8_SQL,
    "op11_spelling_variants": variants.OP11_SQL}
