"""Where samples come from and go to: tables, Parquet stores, JSON writes, exposition text and scraped targets."""
