"""Where frames come from: bars built from event tables, synthetic bars, CSV, JSON graphs and Markdown chapters."""
