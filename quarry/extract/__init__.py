"""Source text to rows: a tokenizer for JavaScript and TypeScript and what is read off its tokens."""
