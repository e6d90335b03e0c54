"""Explicit schemas of the records; nothing is inferred."""

from __future__ import annotations

COMMON = "common struct<mid:string,is_new:string,vc:string,ch:string,ar:string>"
PAGE = "page struct<page_id:string,last_page_id:string,item:string,item_type:string,during_time:bigint>"
LOG = f"{COMMON}, start struct<entry:string,loading_time:bigint>, {PAGE}, displays array<struct<item:string,item_type:string>>, ts bigint"
CHANGE = "database string, tableName string, before map<string,string>, after map<string,string>, type string"
RAW_CHANGE = "topic string, before map<string,string>, after map<string,string>, op string"
RULE = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string"
MONEY = "decimal(16,2)"
