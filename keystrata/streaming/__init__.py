"""Record sorting over streams of arriving files."""
