"""Column lists and state values of the feedback table."""
from __future__ import annotations

PENDING, REVIEWED, LOW_CONFIDENCE = 0, 1, 2
SYNC_FAILED, SYNC_NONE, SYNC_DONE, SYNC_ARCHIVED = -1, 0, 1, 2
LOW_CONFIDENCE_BELOW = 0.52

FEED_ID = "舆情编号"
FEED_FIELDS = ("source", "original_text", "create_time", "model_class", "model_keyword", "match_score",
               "upload_batch", "country", "phone", "vin", "car_model", "extracted_keywords",
               "v3_label_meta", "original_text_md5")

# Header of the yearly archive.
ARCHIVE_COLUMNS = ("舆情编号", "舆情中文", "渠道", "舆情时间", "一级标签", "二级标签", "关键词", "国家",
                   "手机号", "VIN", "车型", "置信度", "复核状态", "复核备注", "年度", "年月", "复核人", "复核时间")
EXPORT_COLUMNS = ("opinion_id", "source", "original_text", "create_time", "model_class", "model_keyword",
                  "match_score", "upload_batch", "review_status", "review_note", "v3_label_meta",
                  "review_l1", "review_l2", "review_l3", "extracted_keywords", "reviewer", "reviewed_at",
                  "reflow_synced")
# Header of the clean library.
CLEAN_COLUMNS = ("舆情编号", "原文", "日期", "模型分类结果", "置信度", "人工分类", "筛选原因", "人工复核结果", "修正原因")
