"""Passages hidden by many replaced letters or by the layout."""

import pytest

from pitspark.llm.abuse import THRESHOLD, score_text


@pytest.mark.parametrize("text", ["What a filthy 4$$h0l3.", "what a filthy 4$$H0L3", "honestly, you are a\nworthless moron and nobody likes you", "> you are a\r\n> worthless moron"])
def test_read(text):
    assert score_text(text)[0] >= THRESHOLD


@pytest.mark.parametrize("text", ["Code 4$$700.", "Serie k9-1100, lot 45510e3", "you are a\n\nworthless moron", "A note to all of you:\nworthless paper is shredded."])
def test_not_read(text):
    assert score_text(text)[0] < THRESHOLD
