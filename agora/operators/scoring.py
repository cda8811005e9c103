"""The rule score of a region and its acceptance gate, as one column expression over its features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.dom import QA, THREAD

#: Conditions over features (SQL), their weights and, where it is not the condition's first word, their label.
RULES = [
    ("schema_org_comment_itemtype", 10),
    ("aria_role_comment", 10),
    ("aria_role_feed_with_articles", 8),
    ("microdata_itemprop_author", 3),
    ("microdata_itemprop_date_published", 3),
    ("microdata_itemprop_text", 4),
    ("json_ld_has_comment_type", 3, "json_ld_comment_type"),
    ("json_ld_has_comment_action", 2, "json_ld_comment_action"),
    ("comment_header_with_count", 5),
    ("attributes_contain_keywords", 3),
    ("keyword_container_high", 3),
    ("keyword_text_high", 3),
    ("submit_button_keyword_high", 2),
    ("keyword_unit_high_coverage >= 0.4", 2),
    ("sig_id_count_weak", 2),
    ("sig_id_count_medium", 3),
    ("sig_id_count_strong", 4),
    ("sibling_homogeneity_score >= 0.65", 3),
    ("depth_and_variety_pass", 2),
    ("time_datetime_per_unit >= 0.5", 4),
    ("author_avatar_coverage >= 0.4", 4),
    ("author_timestamp_colocated", 5),
    ("reply_button_unit_coverage >= 0.4", 5, "reply_button_per_unit"),
    ("report_flag_unit_coverage >= 0.15", 2, "report_flag_button_per_unit"),
    ("profile_link_coverage >= 0.4", 4, "user_profile_link_per_unit"),
    ("reaction_coverage >= 0.25", 2, "reaction_count_per_unit"),
    ("edit_delete_coverage >= 0.15", 2, "edit_delete_per_unit"),
    ("sig_id_recursive_nesting", 3),
    ("reply_nesting_depth > 0", 3),
    ("permalink_per_unit", 2),
    ("deleted_placeholder_present", 4),
    ("quote_block_per_unit", 1),
    ("upvote_downvote_pair", 3),
    ("pinned_post_indicator", 1),
    ("collapse_expand_control", 2),
    ("pagination_load_more_adjacent", 2),
    ("has_nearby_textarea", 2),
    ("aligned_with_textarea", 2),
    ("aligned_with_content_editable", 2),
    ("submit_button_present", 1),
    ("char_counter_near_textarea", 1),
    ("has_avatar", 1),
    ("includes_author", 2),
    ("has_relative_time", 2),
    ("external_link_density_low", 1),
    ("has_text_content AND text_word_count >= 40", 2, "substantial_text_content"),
    ("repeating_group_count >= 4 AND sibling_homogeneity_score >= 0.75", 2, "strong_repeating_structure"),
    ("text_contains_links AND repeating_group_count >= 3", 1, "repeating_link_collection"),
    ("table_row_structure AND NOT (has_text_content AND text_word_count >= 40)", -6),
    ("no_text_content_in_units", -6),
    ("add_to_cart_present", -8),
    ("nav_header_ancestor", -4),
    ("high_external_link_density", -3),
    ("star_rating_no_text", -4),
    ("price_currency_in_unit AND ugc_type <> 'product_review'", -4),
    ("link_density > 0.75", -2, "link_density_too_high"),
]
EXPLICIT = ["comment_header_with_count", "keyword_container_high", "keyword_unit_high_coverage >= 0.25", "keyword_attr_name_high", "keyword_attr_value_high", "keyword_direct_text_high", "keyword_text_high", "submit_button_keyword_high"]
SUPPORTING = ["attributes_contain_keywords", "keyword_unit_high", "keyword_tag_name_high"]
MEDIUM = ["keyword_text_med", "submit_button_keyword_med", "keyword_container_med"]
SEMANTIC = ["schema_org_comment_itemtype", "aria_role_comment", "aria_role_feed_with_articles", "microdata_itemprop_text", "microdata_itemprop_author", "microdata_itemprop_date_published"]
STRUCTURAL = ["sig_id_count_medium", "sig_id_count_strong", "sibling_homogeneity_score >= 0.65", "depth_and_variety_pass", "author_timestamp_colocated", "time_datetime_per_unit >= 0.5", "author_avatar_coverage >= 0.4", "profile_link_coverage >= 0.4", "reply_button_unit_coverage >= 0.4", "sig_id_recursive_nesting", "reply_nesting_depth > 0", "upvote_downvote_pair"]
INTERACTION = ["reply_button_unit_coverage >= 0.4", "report_flag_unit_coverage >= 0.15", "permalink_per_unit", "reaction_coverage >= 0.25", "edit_delete_coverage >= 0.15", "collapse_expand_control", "pagination_load_more_adjacent", "has_nearby_textarea"]
REPEATED = ["sig_id_count_medium", "sig_id_count_strong", "sibling_homogeneity_score >= 0.65", "depth_and_variety_pass"]


def label_of(rule: tuple) -> str:
    return rule[2] if len(rule) > 2 else rule[0].split()[0]


def _if(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def _count(conditions: list[str]) -> Column:
    return reduce(Column.__add__, (_if(c).cast("int") for c in conditions))


def ugc_type() -> Column:
    container = F.coalesce(F.col("keyword_container_raw"), F.lit(""))
    return (
        F.when(_if("star_rating_present AND has_text_content AND NOT add_to_cart_present"), "product_review")
        .when(_if("aria_role_feed OR share_button_per_unit OR text_contains_mentions OR text_contains_hashtags"), "social_feed")
        .when(container.rlike(QA), "qa_answers")
        .when(_if("(reply_button_per_unit OR has_nearby_textarea OR comment_header_with_count) AND NOT upvote_downvote_pair AND NOT thread_depth_indicator"), "comment_thread")
        .when(_if("upvote_downvote_pair OR reply_nesting_depth > 0 OR sig_id_recursive_nesting OR thread_depth_indicator") | container.rlike(THREAD), "forum_thread")
        .when(_if("schema_org_comment_itemtype"), "comment_thread")
        .otherwise("ugc_region")
    )


def scored(regions: DataFrame) -> DataFrame:
    """Regions with score, detected, confidence, ugc_type, signals, gate tier and pseudo label.

    Every feature that a rule reads must be there: a missing one is an error and not a zero.
    """
    out = regions.withColumn("ugc_type", ugc_type())
    out = out.withColumn("score", reduce(Column.__add__, (F.when(_if(r[0]), r[1]).otherwise(0) for r in RULES)))
    labels = lambda keep: F.array_compact(F.array(*(F.when(_if(r[0]), label_of(r)) for r in RULES if keep(r[1]))))
    out = out.withColumns({"matched_signals": labels(lambda w: w > 0), "penalty_signals": labels(lambda w: w < 0)})
    out = out.withColumns({"n_explicit": _count(EXPLICIT), "n_supporting": _count(SUPPORTING), "n_medium": _count(MEDIUM), "semantic_support_count": _count(SEMANTIC), "structural_support_count": _count(STRUCTURAL), "interaction_support_count": _count(INTERACTION), "repeated_structure_support": _count(REPEATED) > 0})
    strong = _if("n_explicit > 0 OR n_supporting >= 2")
    medium = ~strong & _if("n_medium > 0 AND repeated_structure_support AND structural_support_count >= 3 AND interaction_support_count >= 1 AND score >= 18")
    override = ~strong & _if("n_medium = 0 AND semantic_support_count >= 2 AND repeated_structure_support AND structural_support_count >= 5 AND interaction_support_count >= 3 AND NOT table_row_structure AND NOT add_to_cart_present AND NOT nav_header_ancestor AND score >= 26")
    tier = F.when(_if("n_explicit > 0"), "strong_keywords").when(strong, "reinforced_keywords").when(medium, "medium_keywords_plus_structure").when(override, "high_assurance_override").otherwise("rejected_missing_keywords")
    out = out.withColumn("keyword_gate_tier", tier)
    base = _if("score >= 12 OR ((schema_org_comment_itemtype OR aria_role_comment) AND score >= 8)")
    out = out.withColumns({
        "confidence": F.when(F.col("score") >= 24, "high").when(F.col("score") >= 16, "medium").when(F.col("score") >= 10, "low").otherwise("unlikely"),
        "acceptance_gate_passed": F.col("keyword_gate_tier") != "rejected_missing_keywords",
        "detected": base & (F.col("keyword_gate_tier") != "rejected_missing_keywords"),
    })
    keyworded = F.col("keyword_gate_tier").isin("strong_keywords", "reinforced_keywords", "medium_keywords_plus_structure")
    label = F.when(F.col("detected"), "ugc").when((F.col("score") >= 10) | F.col("repeated_structure_support") | keyworded, "uncertain").otherwise("not_ugc")
    return out.withColumn("heuristic_pseudo_label", label)
