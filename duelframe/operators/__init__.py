"""DataFrame operators over prompts, candidates, dialogues, tokens and judgements."""
