"""Schemas of the record formats, as DDL text. Readers use these and never infer."""

from __future__ import annotations

PAGE = "page_id long, url string, html string"
PAPER = (
    "title string, authors string, venue string, affinity_score double, link string, keywords string, bibtex string"
)
LISTED_SESSION = "title string, url string, session_type string, speakers string"
MODAL_LINK = "title string, data_event_modal string"
DETAILED_SESSION = (
    "session_id string, title string, session_type string, format string, recording string, abstract string, "
    "industry string, topic string, technical_level string, intended_audience string, nvidia_technology string, "
    "key_takeaways array<string>, speakers array<struct<name:string,title:string,company:string>>, url string, "
    "date string, time string, location string, key_themes array<string>, error string"
)
SPONSOR = "name string, tier string, company_url string"
FLAT_SESSION = (
    "session_id string, title string, date string, start string, end string, room string, "
    "speakers array<struct<name:string,title:string,company:string>>, format string, recording string, "
    "session_type string, topic string, url string, key_themes array<string>, "
    "code string, location string, sessionType string, mainTopic string, keyThemes array<string>"
)
ENVELOPE_SESSION = (
    "title string, type string, date string, startTime string, endTime string, location string, "
    "speaker array<string>, abstract string, overview string, transcript string, sessionUrl string, "
    "topic array<string>, affiliation array<string>, technology array<string>, sessionFormat string, "
    "hasRecording boolean, intendedAudience string, publicationTitles array<string>"
)
PUBLICATION = (
    "title string, authors array<string>, abstract string, summary string, affiliations array<string>, "
    "countries array<string>, keywords array<string>, researchTopic string, status string, rating double, "
    "doi string, pdfUrl string, githubUrl string, websiteUrl string"
)
KEYNOTE = (
    "id string, title string, speaker string, affiliation string, speaker_url string, session_text string, "
    "date string, startTime string, endTime string, location string, abstract string, bio string"
)
TUTORIAL = (
    "number string, title string, organizers array<struct<name:string,affiliation:string>>, duration string"
)
WORKSHOP = (
    "number string, sequence int, title string, organizers array<struct<name:string,affiliation:string>>, "
    "duration string, date string, day_label string, url string, page_title string, overview string, "
    "overview_source string, startTime string, endTime string, room string"
)
MATCH_SCORE = (
    "bu_name string, session_title string, session_type string, session_date string, session_time string, "
    "base_cosine double, rel double, tech_overlap double, novelty double, actionability double, "
    "confidence double, final_score double, scoring_reason string, recommendation_reason string, focus_areas string"
)
