"""Struct types of the rows that move between operators."""

CONTACT = (
    "struct<title:string,first_name:string,last_name:string,email:string,phone:string,"
    "mobile:string,linkedin_url:string>"
)
SEARCH_RESULT = "struct<title:string,link:string,snippet:string,domain:string>"
SEARCH_PAYLOAD = f"struct<query:string,results:array<{SEARCH_RESULT}>,candidate_domain:string>"
PROFILE_RESULT = "struct<title:string,link:string,snippet:string>"
INTEL = (
    "struct<industry:string,niche:string,description:string,address:string,phone:string,"
    "target_market:string,case_studies:array<string>,"
    "website_contacts:array<struct<name:string,title:string>>,general_emails:array<string>,"
    "homepage_raw_text:string>"
)
ORGANIC_BODY = f"struct<organic:array<{PROFILE_RESULT}>,_corrupt_record:string>"
# Answers are read as strings first: a bad cell then spoils its entry, not the whole document.
FUNDING_ENTRY = (
    "struct<item_index:string,is_funding_round:string,company_name:string,funding_amount:string,"
    "funding_round:string,lead_investor:string,description_snippet:string>"
)
