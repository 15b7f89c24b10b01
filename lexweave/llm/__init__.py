"""Training-data operators: language ID, near-dedup, quality, decontamination, URL filters, BPE,
HTML extraction, LM scoring, licence scans and chat formatting. Nothing outside imports this package."""
