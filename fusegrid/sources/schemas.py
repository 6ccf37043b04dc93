"""Explicit schemas of the record types."""

ELEMENT = "id string, name string, category string, element_type string, design_system string, html_template string, css_classes array<string>, tags array<string>, embedding array<float>, created_at timestamp, updated_at timestamp"
DESIGN_SYSTEM = "name string, display_name string, version string, description string, docs_url string, created_at timestamp"
SNIPPET = "id string, name string, html string, css string, js string, design_system string, tags array<string>, element_ids array<string>, element_count int, created_at timestamp, updated_at timestamp"
EDGE = "src string, dst string, rel_type string, score double, props string, created_at timestamp"
POINT = "id string, collection string, vector array<float>, name string, category string, element_type string, design_system string, confidence double, css_classes array<string>, tags array<string>"
FEEDBACK = "id string, generation_id string, element_ids array<string>, feedback_type string, query_context string, comment string, confidence_delta double, created_at timestamp"
STATEMENT = "statement string, frequency double, confidence double"
MESSAGE = "id string, type string, timestamp bigint, payload string"
NODE = "node_id int, parent_id int, depth int, tag string, id string, classes array<string>, attributes map<string,string>, text string"
