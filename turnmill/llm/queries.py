"""The queries of the ten problems."""

from __future__ import annotations

from turnmill.plans.registry import Registry

LLM = Registry()


@LLM.add("p1_found")
def p1_found(t):
    from turnmill.llm import p1_history

    return p1_history.all_batches(t("staged"))


@LLM.add("p2_found")
def p2_found(t):
    from turnmill.llm import p2_near

    return p2_near.near_pairs(t("exchanges"), t("staged"))


@LLM.add("p2_classes")
def p2_classes(t):
    from turnmill.llm import p2_near

    return p2_near.classes(t("exchanges"), t("staged"))


@LLM.add("p9_found")
def p9_found(t):
    from turnmill.llm import p9_leaks

    return p9_leaks.leaks(t("documents"), t("eval_items"))


@LLM.add("p9_edited")
def p9_edited(t):
    from turnmill.llm import p9_leaks

    return p9_leaks.leaks(t("documents"), t("eval_items"), window=None)


@LLM.add("p10_found")
def p10_found(t):
    from turnmill.llm import p10_repetition

    return p10_repetition.found(t("documents"))


@LLM.add("p10_repetition")
def p10_repetition_(t):
    from turnmill.llm import p10_repetition

    return p10_repetition.repetition(t("documents")).drop("pattern")


@LLM.add("p8_packing")
def p8_packing_(t):
    from turnmill.llm import p8_packing

    return p8_packing.packing(t("documents"), t("pack_sizes"))


@LLM.add("p7_found")
def p7_found(t):
    from turnmill.llm import p7_pairs

    return p7_pairs.defects(t("exchanges"))


@LLM.add("p3_found")
def p3_found(t):
    from turnmill.llm import p3_quality

    return p3_quality.found(t("staged"))


@LLM.add("p3_statistics")
def p3_statistics(t):
    from turnmill.llm import p3_quality

    return p3_quality.statistics(t("staged"))


@LLM.add("p4_found")
def p4_found(t):
    from turnmill.llm import p4_language

    return p4_language.found(t("staged"))


@LLM.add("p4_segments")
def p4_segments(t):
    from turnmill.llm import p4_language

    return p4_language.segments(t("staged"))


@LLM.add("p4_documents")
def p4_documents(t):
    from turnmill.llm import p4_language

    return p4_language.documents(t("staged"))


@LLM.add("p5_found")
def p5_found(t):
    from turnmill.llm import p5_pii

    return p5_pii.found(t("exchanges"), t("staged"), t("sample_messages"), t("known_names"))


@LLM.add("p5_redacted")
def p5_redacted(t):
    from turnmill.llm import p5_pii

    return p5_pii.redacted(t("exchanges"), t("staged"), t("sample_messages"), t("known_names"))


@LLM.add("p6_found")
def p6_found(t):
    from turnmill.llm import p6_toxic

    return p6_toxic.found(t("staged"), t("labels"), t("flag_terms"))


@LLM.add("p6_scores")
def p6_scores(t):
    from turnmill.llm import p6_toxic

    return p6_toxic.scores(t("staged"), t("labels"), t("flag_terms"))


@LLM.add("p6_rates")
def p6_rates(t):
    from turnmill.llm import p6_toxic

    return p6_toxic.rates(t("staged"), t("exchanges"), t("sessions"), t("labels"), t("flag_terms"))
