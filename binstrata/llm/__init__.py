"""Operations on the text corpus: encoding, packing and splitting, sized in tokens of a public tokenizer."""
