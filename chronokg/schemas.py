"""Schemas of the five tables and of what models answer, as Spark DDL."""

TEXT_UNITS = """id string, text string, contextualized_text string, text_tokens int, book_number int, book_title string, chunk_index int, global_chunk_index long,
    relative_position double, headings array<string>, metadata map<string,string>, entities array<string>, relationships array<string>, embedding array<float>"""
ENTITIES = "name string, type string, book_number int, chapter string, description string, descriptions_raw array<string>, text_unit_ids array<string>, embedding array<float>"
RELATIONSHIPS = "id string, source string, target string, book_number int, chapter string, description string, descriptions_raw array<string>, type string, weight double, text_unit_ids array<string>"
COMMUNITIES = """id string, book_number int, title string, summary string, report string, temporal_range_start int, temporal_range_end int, relative_position_start double,
    relative_position_end double, entities array<string>, relationships array<string>, text_unit_ids array<string>, embedding array<float>"""
CHUNK_FILE = "chunk_id string, text string, contextualized_text string, text_tokens int, tokens int, sentence_count int, page_numbers array<int>, filename string, headings array<string>, metadata map<string,string>"
PARSED_DOCUMENT = """origin struct<filename:string>, body struct<children:array<struct<cref:string>>>,
    texts array<struct<text:string,label:string,level:int,prov:array<struct<page_no:int>>>>, tables array<struct<label:string,data:struct<table_cells:array<struct<text:string>>>>>"""
EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string,type:string,strength:double>>"
REPORT = "title string, summary string, report string"

#: Fixed values of the data contract.
NO_DESCRIPTION, UNKNOWN, DEFAULT_STRENGTH = "Нет описания", "UNKNOWN", 5
EMBED_TOKENS, CHECKPOINT_EVERY, TOP_EDGES, DETAIL_CAP = 509, 20, 10, 50
CONTEXT_TOKENS, COMMUNITY_SHARE, SOURCE_SHARE = 12032, 0.10, 0.55
