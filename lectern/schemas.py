"""Schemas of the tables the jobs read; declared, never inferred."""

from __future__ import annotations

BOX = "struct<left:double,top:double,right:double,bottom:double>"
ANCHOR = f"struct<paper_id:string,section_id:string,block_id:string,page:int,bbox:{BOX},source_text:string>"
SECTION = f"struct<id:string,title:string,level:int,order:int,page_start:int,page_end:int,markdown:string,anchors:array<{ANCHOR}>>"
FIGURE = f"struct<id:string,caption:string,relative_path:string,thumbnail_path:string,page:int,bbox:{BOX},mime_type:string>"
DOCUMENT = f"id string, title string, page_count int, sections array<{SECTION}>, figures array<{FIGURE}>"

FILE_EVENTS = "event_id string, event_type string, path string, previous_path string, ts timestamp, root string"
LAYOUT = "paper_id string, page int, page_w double, page_h double, block_id string, rect struct<x0:double,y0:double,x1:double,y1:double>, text string"
JOB_EVENTS = "event_id long, job_id string, status string, progress double, message string, ts timestamp"
MODEL_EVENTS = "request_id string, seq long, ts timestamp, kind string, text string, reasoning_characters int, input_tokens long, output_tokens long, error string"

EXPORT = {
    "items": "itemID long, key string",
    "itemAttachments": "itemID long, parentItemID long, path string, contentType string, storageModTime long",
    "deletedItems": "itemID long",
    "itemData": "itemID long, fieldID long, valueID long",
    "fields": "fieldID long, fieldName string",
    "itemDataValues": "valueID long, value string",
    "itemCreators": "itemID long, creatorID long, orderIndex int",
    "creators": "creatorID long, firstName string, lastName string",
    "collections": "collectionID long, collectionName string, parentCollectionID long",
    "collectionItems": "collectionID long, itemID long, orderIndex int",
}
