"""Training-data operators: quality, licences, near-duplicates, packing, mixing, chat, URLs, token counts."""
