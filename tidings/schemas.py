"""Explicit schemas. Unknown input fields are ignored because nothing is inferred."""

from __future__ import annotations

SELECTORS = "struct<articles:string,title:string,content:string,date:string>"

SOURCE = (
    "struct<name:string,type:string,url:string,channelId:string,channelHandle:string,subreddit:string,"
    "sortBy:string,clientType:string,maxResults:int,timeRangeDays:int,selectors:" + SELECTORS + ">"
)

CONFIG = (
    "sources array<" + SOURCE + ">, "
    "global struct<cacheTimeMinutes:int,userAgent:string>, "
    "llm struct<provider:string,model:string,summaryPromptFile:string>"
)

PAYLOAD = "source_name string, source_type string, path string, page_no int, fetched_at timestamp, body string"

RSS_ITEM = (
    "struct<_about:string,title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,"
    "date:string,creator:string,author:string,category:array<string>,subject:array<string>,description:string,"
    "encoded:string>"
)

# Items stand in the channel, in RSS 1.0 beside it.
RSS = f"channel struct<title:string,description:string,item:array<{RSS_ITEM}>>, item array<{RSS_ITEM}>"

ATOM = (
    "title string, subtitle string, entry array<struct<id:string,title:string,"
    "link:array<struct<_href:string,_rel:string>>,published:string,author:array<struct<name:string>>,"
    "category:array<struct<_term:string>>,summary:string,content:string>>"
)

POST = (
    "struct<id:string,title:string,author:string,url:string,selftext:string,created:double,score:int,"
    "num_comments:int,over_18:boolean>"
)

LISTING = "data struct<after:string,before:string,children:array<struct<kind:string,data:" + POST + ">>>"

SEARCH = (
    "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,"
    "publishedAt:string,channelId:string,channelTitle:string,thumbnails:struct<high:struct<url:string>>>>>"
)

# The archive keeps the field names of the record users already hold.
ARCHIVE = (
    "id string, title string, content string, url string, publishDate string, author string, sourceType string, "
    "sourceName string, metadata map<string,string>"
)

DIGEST = "part long, generated_at timestamp, status string, body string, run_date date"

ITEM_COLUMNS = (
    "id", "title", "content", "url", "publish_date", "publish_zone", "author", "source_type", "source_name",
    "metadata", "run_date", "as_of", "source_ord", "page_no", "item_pos",
)

ERROR_COLUMNS = ("source_name", "stage", "reason", "body_sha")

SOURCE_TYPES = ("youtube", "reddit", "rss", "scrape")
